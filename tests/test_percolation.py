"""Spanning forests, merge trees and what breaks off, against brute force over all edges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import percolation, structure

N = 60


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    edges = {}
    for _ in range(170):
        a, b = sorted(rng.sample(range(N - 4), 2))
        near = a // 14 == b // 14
        edges[a, b] = rng.choice((0.31, 0.5, 0.9, 1.0)) if rng.random() < 0.5 else round(rng.uniform(0.4, 1) if near else rng.uniform(0, 0.5), 3)
    rows = [(a, b, w, w, round(1 - w / 2, 3)) for (a, b), w in edges.items()]
    pairs = spark.createDataFrame(rows, "a long, b long, jaccard double, idf_jaccard double, hamming double")
    found = spark.createDataFrame([(i, i % 5 + 1, [t for t in "xyz" if rng.random() < 0.6]) for i in range(N)], "idx long, size long, tokens array<string>")
    return found, pairs, {e: w for e, w in edges.items() if w > 0}


def labels_at(edges, threshold, nodes=range(N)):
    label = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for (a, b), w in edges.items():
            if w >= threshold and a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def sizes(label):
    told = {}
    for v in label.values():
        told[v] = told.get(v, 0) + 1
    return told


def test_forest_tree_and_sweep(spark, graph):
    found, pairs, edges = graph
    forest = percolation.spanning_forest(percolation.weighted(pairs)).cache()
    kept, label = [], {i: i for i in range(N)}
    for (a, b), w in sorted(edges.items(), key=lambda e: -e[1]):
        if label[a] != label[b]:
            kept.append(w)
            old, new = label[a], label[b]
            label = {i: new if v == old else v for i, v in label.items()}
    assert sorted(r["weight"] for r in forest.collect()) == sorted(kept)
    for t in (0.2, 0.31, 0.5, 0.9):
        assert {r["idx"]: r["label"] for r in percolation.cut(found, forest, t).collect()} == labels_at(edges, t)
    tree = percolation.merge_tree(forest).cache()
    levels = {t: labels_at({e: min(100, int(w * 100 // 1)) if w < 1 else 100 for e, w in ((e, round(w, 12)) for e, w in edges.items())}, t) for t in range(102)}
    want = set()
    for t in range(101):
        above, here = sizes(levels[t + 1]), sizes(levels[t])
        for i in range(N):
            child, parent = levels[t + 1][i], levels[t][i]
            if above[child] != here[parent]:
                want.add((t, child, above[child], parent, here[parent]))
    got = tree.collect()
    assert {tuple(r[c] for c in ("level", "child", "child_size", "parent", "parent_size")) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["born"] == 101 if r["child_size"] == 1 else sizes(levels[r["born"]])[r["child"]] == r["child_size"] and sizes(levels[r["born"] + 1]).get(r["child"]) != r["child_size"]
    told = {round(r["threshold"] * 100): r for r in percolation.sweep(found, tree).collect()}
    for t in range(101):
        n = sorted(sizes(levels[t]).values(), reverse=True)
        assert (told[t]["families"], told[t]["largest"], told[t]["second"], told[t]["singletons"], told[t]["second_moment"]) == (len(n), n[0], n[1], n.count(1), sum(x * x for x in n[1:])), t
        assert told[t]["mean_finite_size"] == pytest.approx(sum(x * x for x in n[1:]) / sum(n[1:]))


def test_pieces_contrast_audit_and_bridges(spark, graph):
    found, pairs, edges = graph
    edge_rows = percolation.weighted(pairs)
    before, after = 0.31, 0.7
    broken = percolation.pieces(found, structure.families(found, pairs, before), structure.families(found, pairs, after)).cache()
    low, high = labels_at(edges, before), labels_at(edges, after)
    top = min(sizes(low).items(), key=lambda x: (-x[1], x[0]))[0]
    inside = [i for i in range(N) if low[i] == top]
    order = sorted({high[i] for i in inside}, key=lambda v: (-sum(high[i] == v for i in inside), v))
    piece = {i: order.index(high[i]) + 1 for i in inside}
    assert {r["idx"]: r["piece"] for r in broken.collect()} == piece and len(order) > 3
    rows = {r["idx"]: r for r in found.collect()}
    share = lambda some, t: sum(rows[i]["size"] for i in some if t in rows[i]["tokens"]) / sum(rows[i]["size"] for i in some)
    members = {p: [i for i in inside if piece[i] == p] for p in piece.values()}
    major = [p for p, m in members.items() if len(m) >= max(10, -(-len(inside) * 2 // 100))]
    for r in percolation.piece_contrast(found, broken).collect():
        p, t = r["piece"], r["token"]
        assert r["share"] == pytest.approx(share(members[p], t)) and r["baseline_share"] == pytest.approx(share(inside, t))
        assert r["contrast"] == pytest.approx(share(members[p], t) - max([0, *(share(members[o], t) for o in major if o != p)])), (p, t)
    hamming = {tuple(x): h for *x, h in ((r["a"], r["b"], r["hamming"]) for r in pairs.collect())}
    for r in percolation.hamming_audit(found, pairs, broken, 0.75).collect():
        m = members[r["piece"]]
        own = sizes(labels_at(hamming, 0.75, m))
        assert (r["groups"], r["subclusters"], r["largest_subcluster"], r["singletons"]) == (len(m), len(own), max(own.values()), list(own.values()).count(1))
        total = sum(h for (a, b), h in hamming.items() if a in m and b in m)
        assert r["mean_hamming"] is None if len(m) == 1 else r["mean_hamming"] == pytest.approx(total / (len(m) * (len(m) - 1) / 2))
    lost = [(a, b, w) for (a, b), w in edges.items() if before <= w < after and a in piece and b in piece and piece[a] != piece[b]]
    for r in percolation.broken_bridges(found, edge_rows, broken, before, after).collect():
        on = [w for a, b, w in lost if r["token"] in rows[a]["tokens"] and r["token"] in rows[b]["tokens"]]
        assert (r["edges"], r["bridges"]) == (len(on), len(lost)) and r["mean_weight"] == pytest.approx(sum(on) / len(on))


def test_nothing_to_span(spark, graph):
    found, pairs, _ = graph
    none = percolation.spanning_forest(percolation.weighted(pairs.limit(0)))
    assert none.count() == 0 and percolation.merge_tree(none).count() == 0
    rows = percolation.sweep(found, percolation.merge_tree(none)).collect()
    assert len(rows) == 101 and {(r["families"], r["largest"], r["second"]) for r in rows} == {(N, 1, 1)}
    same = percolation.spanning_forest(spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (1, 2, 0.5)], "a long, b long, weight double"))
    assert [tuple(r) for r in same.collect()] == [(1, 2, 0.5)]


def test_numbering_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    told = structure.numbered(rows, [F.desc("v")], "at").collect()
    assert all(r["at"] == 999 - r["v"] for r in told) and structure.numbered(rows.limit(0), [F.asc("v")], "at").count() == 0
