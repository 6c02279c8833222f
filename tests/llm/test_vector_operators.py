"""Vector operators against brute force."""

import os

import numpy as np
import pytest

from tidemark.llm import ann, embdedup, queries

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "h") for i, v in rows], "vec_id long, embedding array<float>, label int, h0 string")


def vectors(seed=0, n=220, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = [(int(i), centres[i % 12] + rng.standard_normal(dim) * rng.choice((0.0, 0.15, 0.3))) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (n + 4, [1.0] * (dim - 1)), (n + 5, [float("inf")] * dim)]
    return rows, odd


def test_embedding_links_equal_brute_force(spark):
    rows, odd = vectors()
    told = {r["vec_id"]: r for r in embdedup.link(table(spark, rows + odd)).collect()}
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    assert [told[i]["n_links"] for i, _ in rows] == links.tolist() and [told[i]["component_id"] for i, _ in rows] == label.tolist()
    assert all(told[i]["n_links"] == 0 and told[i]["kept"] for i, _ in odd) and len(told) == len(rows) + len(odd)
    assert embdedup.link(table(spark, odd)).count() == len(odd) and embdedup.link(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("per_cell", [None, 64])
def test_links_of_a_dense_group_over_many_cells(spark, monkeypatch, per_cell):
    if per_cell:
        monkeypatch.setattr(embdedup, "PER_CELL", per_cell, raising=False)
    rng = np.random.default_rng(4)
    n, dim = 4800, 64
    x = rng.standard_normal((n, dim))
    x[: n * 3 // 4] = rng.standard_normal(dim) + 0.3 * rng.standard_normal((n * 3 // 4, dim))
    x = x.astype(np.float32).astype(np.float64)
    told = {r["vec_id"]: r for r in embdedup.link(table(spark, list(enumerate(x)))).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while ((least := np.minimum(label, np.where(near, label[None, :], n).min(1))) != label).any():
        label = least
    assert [told[i]["n_links"] for i in range(n)] == near.sum(1).tolist() and near.sum() > 100_000
    assert [told[i]["component_id"] for i in range(n)] == label.tolist()


def test_unbiased_estimates():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((400, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    turn = embdedup.rotation(32)
    codes, factors = embdedup.encode(u, turn)
    told, width = embdedup.estimate(codes, factors, u @ turn)
    error = told - u @ u.T
    assert abs(error[~np.eye(400, dtype=bool)].mean()) < 2e-3 and (np.abs(error) <= width[:, None] + 1e-6).mean() > 0.9999


def truth(x, ids, asked, k):
    found = {}
    for i in asked:
        score = (x * x[ids.index(i)]).sum(1)
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-score[j], ids[j]))[:k]
        found[i] = [(ids[j], score[j]) for j in order]
    return found


def test_neighbours_with_few_rows_and_odd_vectors(spark):
    rows, odd = vectors(3, 15)
    told = ann.search(table(spark, rows + odd), table(spark, rows[:3] + odd), k=20).collect()
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    want = truth(x, [i for i, _ in rows], [0, 1, 2], 20)
    for i, near in want.items():
        got = sorted((r for r in told if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in got] == [j for j, _ in near] and [r["rank"] for r in got] == list(range(1, 15))
        assert [r["score"] for r in got] == pytest.approx([s for _, s in near], abs=1e-12)
    assert {r["query_id"] for r in told} == {0, 1, 2} and ann.search(table(spark, odd), table(spark, odd)).count() == 0


def test_queries_look_far_enough_past_their_own_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "candidates_needed", lambda *a: 1)
    rows, _ = vectors(5)
    told = ann.search(table(spark, rows + [(0, v + 0.001) for _, v in rows[::12]]), table(spark, rows[:6]), k=20).collect()
    ranks = {q: sorted(r["rank"] for r in told if r["query_id"] == q) for q in range(6)}
    assert all(r == list(range(1, 21)) for r in ranks.values())


def test_cells_share_blocks_and_hot_ones_are_divided(spark, monkeypatch):
    sizes = np.array([[30, 30, 30, 900], [0, 50, 0, 20]], np.int32)
    block, divisions = ann.blocks_of(sizes, 64)
    assert block.tolist() == [[0, 0, 1, 2], [0, 0, 0, 1]] and divisions.tolist() == [[1, 1, 1, 15], [1, 1, 1, 1]]
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = [(x, y, i) for x in range(2) for y in range(4) for i in range(sizes[x, y])]
    placed = spark.createDataFrame([(n, b"", x, y) for n, (x, y, _) in enumerate(rows)], "vec_id long, vec binary, x int, y int")
    probes = spark.createDataFrame([(q, b"%d" % q, 0, 2, d, b"") for q in range(300) for d in range(15)] + [(7, b"", 1, 0, 0, b"")], "vec_id long, vec binary, x int, block int, division int, want binary")
    stored, asked = ann._deal(placed, probes, sizes, block, divisions)
    group = ["x", "block", "division", "part"]
    largest = lambda df: df.groupBy(*group).count().agg({"count": "max"}).first()[0]
    assert largest(stored) < 120 and largest(asked) < 120
    met = stored.alias("a").join(asked.alias("b"), group).select("a.vec_id", "b.vec_id")
    assert met.count() == met.distinct().count() == 900 * 300 + 50


def test_recall_where_cells_are_left_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((150, 24))
    x = (centres[rng.integers(0, 150, 12_000)] + 0.4 * rng.standard_normal((12_000, 24))).astype(np.float32).astype(np.float64)
    x[:4000] = centres[0] + 0.2 * rng.standard_normal((4000, 24))
    x = x.astype(np.float32).astype(np.float64)
    every = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    told = ann.search(every, every.where("vec_id % 20 = 0"), k=20).collect()
    got = {}
    for r in told:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in range(0, len(x), 20):
        score = x @ x[i]
        score[i] = -np.inf
        near = set(np.argsort(-score, kind="stable")[:20].tolist())
        assert sorted(r for r, _, _ in got[i]) == list(range(1, 21)) and all(abs(s - score[j]) < 1e-9 for _, j, s in got[i])
        hits += len(near & {j for _, j, _ in got[i]})
    assert hits >= 0.9 * len(x)


def test_ids_with_more_rows_than_are_asked_for(spark):
    v = [1.0, 2.0, 0.5, 1.0]
    rows = [(20, v)] * 25 + [(i, v) for i in range(21, 26)]
    got = ann.search(table(spark, rows), table(spark, rows[:25]), k=20).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, i + 1, 21 + i) for i in range(5)]
    # 30 rows of the nearest id fill an answer; another vector under the query's id is a query of its own
    rows = [(20, v), (20, [-1.0, 0.0, 0.0, 0.0]), (7, [-3.0, 0.0, 0.0, 0.0])] + [(21, v)] * 30 + [(22, v)] * 30
    got = ann.search(table(spark, rows), table(spark, rows[:2]), k=20).collect()
    by = sorted((r["rank"], r["vec_id"]) for r in got)
    assert by == sorted([(i + 1, 21) for i in range(20)] + [(1, 7)] + [(i + 2, 21) for i in range(19)])


def test_repeated_ids_and_links(spark):
    rows, _ = vectors(9, 30)
    rows += [(3, rows[3][1]), (3, rows[7][1] * 2), (None, rows[2][1])]
    told = embdedup.link(table(spark, rows)).collect()
    x = np.array([np.float32(v) for _, v in rows[:-1]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    both = links[3] + links[31]  # rows of id 3: two equal vectors, and one that links with 7
    assert sorted(r["n_links"] for r in told if r["vec_id"] == 3) == [both - 1, both, both] and len(told) == len(rows)
    assert all(r["n_links"] == links[r["vec_id"]] for r in told if r["vec_id"] not in (None, 3))
    assert {r["component_id"] for r in told if r["vec_id"] in (3, 7)} == {3}
    found = ann.search(table(spark, rows), table(spark, rows[:4]), k=20).collect()
    assert {r["query_id"] for r in found} == {0, 1, 2, 3} and not any(r["query_id"] == r["vec_id"] for r in found)


def test_planted_pairs_at_the_limit(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.91 * a + (1 - 0.91**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, b]).astype(np.float32).astype(np.float64)
    told = embdedup.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(r["n_links"] for r in told) >= 0.999 * want.sum() and all(r["n_links"] <= want[r["vec_id"]] for r in told)


@needs_data
def test_recall(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), np.float64)
    told = queries.op1_nearest_neighbours(spark, SF).collect()
    want = truth(x, ids, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in told:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[i] & {j for j, _ in near}) / 20 for i, near in want.items()]) >= 0.9
