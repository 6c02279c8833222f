"""Nearest neighbours by inner product through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.common import if_small
from tidemark.session import materialize

#: Codebooks are fitted on a sample of about so many vectors, or so many for each centroid; every vector is indexed.
FIT_VECTORS, FIT_PER_CENTROID = 20_000, 16
#: Centroids of each half: so many cells squared, of about 36 entries each. The upper bound, reached at 150 million vectors,
#: bounds the table of cell sizes that every query task holds (MOST_CENTROIDS ** 2 numbers of 4 bytes: 17 MB).
LEAST_CENTROIDS, MOST_CENTROIDS = 8, 2048
#: The number of entries a query looks at is set so that this share of true neighbours lies in them,
#: measured by brute force for so many sampled queries over all entries.
TARGET_RECALL, CALIBRATION_QUERIES = 0.96, 128
#: Cells of a left centroid are compared together until they hold about so many entries, and so many queries at a time; a
#: cell of more entries is divided.
BLOCK = 2048
#: Queries that one task walks.
QUERIES_A_TASK = 512


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of a vector, and how many entries each pair of centroids holds."""

    split: int
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors.nearest(x[:, : self.split], self.left), vectors.nearest(x[:, self.split :], self.right)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance of a query from each half's centroids: the inner product, negated."""
        return -(self.left @ q[: self.split]), -(self.right @ q[self.split :])

    def traverse(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of centroids by summed distance, nearest first: the multi-sequence walk with a heap."""
        a, b = self.distances(q)
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        i, j = i.tolist(), j.tolist()
        heap, taken = [(a[0] + b[0], 0, 0)], [0] * len(i)
        while heap:
            _, x, y = heapq.heappop(heap)
            yield i[x], j[y]
            taken[x] = y + 1
            # (x, y + 1) follows once (x - 1, y + 1) is taken, (x + 1, y) once (x + 1, y - 1) is
            if y + 1 < len(b) and (x == 0 or taken[x - 1] > y + 1):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if x + 1 < len(a) and taken[x + 1] == y:
                heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))

    def probe(self, q: np.ndarray, enough: int) -> dict[int, list[int]]:
        """The nearest cells that together hold ``enough`` entries, by their left centroid."""
        found: dict[int, list[int]] = {}
        held = 0
        for x, y in self.traverse(q):
            n = self.sizes[x, y]
            if n:
                found.setdefault(x, []).append(y)
                held += n
                if held >= enough:
                    break
        return found


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The ``k`` nearest rows of ``embeddings`` for each row of ``queries``: query_id, rank, vec_id, score.

    Nearness is the largest inner product in double precision, ties to the smaller vec_id;
    a row is no neighbour of the rows that share its vec_id. Of equal vectors no more than
    the k + 1 smallest ids, each with k of its rows, can stand in an answer (one id may be the query's own),
    so only these are indexed. The others are found by that rule and never compared. Vectors that are null, zero, of another
    length or hold null or non-finite components take no part, and rows without vec_id neither.
    Rows that repeat a vec_id are candidates each; as queries, those of one vector are one query and those
    of another have neighbours of their own under the same query_id. With fewer candidates than ``k`` all are returned;
    an empty table gives an empty result. Columns other than vec_id and embedding are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    dim = vectors.dimension(embeddings)
    told = vectors.checked(embeddings, dim).where("vec is not null and vec_id is not null")
    again, ids = Window.partitionBy("h0", "h1", "vec_id").orderBy("vec_id"), Window.partitionBy("h0", "h1").orderBy("vec_id")
    few = told.withColumn("n", F.row_number().over(again)).where(f"n <= {k}").withColumn("n", F.dense_rank().over(ids)).where(f"n <= {k + 1}")
    entries = materialize(few.select("vec_id", "vec"), "entries")
    asked = materialize(vectors.checked(queries, dim).where("vec is not null and vec_id is not null").select("vec_id", "vec").distinct(), "asked")
    count = entries.count()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count or asked.isEmpty():
        return none
    index = fit(entries, dim, count)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = shared.value.cells(vectors.matrix(batch["vec"], dim)) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vec"], pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["vec_id", "vec", "x", "y"])

    placed = materialize(entries.mapInArrow(place, "vec_id long, vec binary, x int, y int"), "placed")
    index.sizes = np.zeros((len(index.left), len(index.right)), np.int32)
    held = placed.groupBy("x", "y").agg(F.count("*").cast("int").alias("n")).toArrow()  # one row per cell, MOST_CENTROIDS ** 2 at most
    index.sizes[held["x"].to_numpy(), held["y"].to_numpy()] = held["n"].to_numpy()
    enough = candidates_needed(placed, asked, index, dim, count, k, target_recall)
    # a query's own rows are no answer, so it looks at k entries more than any vec_id has
    own = placed.groupBy("vec_id").count().agg(F.max("count").alias("most")).first()["most"]
    return _rerank(placed, asked, index, dim, max(enough, own + k), k)


def fit(entries: DataFrame, dim: int, count: int) -> MultiIndex:
    """Codebooks of both halves from a bounded sample; a vector of one number has an empty right half."""
    k = int(np.clip(round(count**0.5 / 6), LEAST_CENTROIDS, MOST_CENTROIDS))
    most = max(FIT_VECTORS, k * FIT_PER_CENTROID)
    x = vectors.sample(entries, dim, most, count, "ann")
    if not len(x):
        x = vectors.sample(entries, dim, most, 1, "ann")
    split = (dim + 1) // 2
    right = vectors.kmeans(x[:, split:], k) if dim > 1 else np.zeros((1, 0))
    return MultiIndex(split, vectors.kmeans(x[:, :split], k), right)


def candidates_needed(placed, asked, index: MultiIndex, dim: int, count: int, k: int, target: float) -> int:
    """How many entries a query has to look at to find ``target`` of its true neighbours.

    For a bounded sample of queries the true neighbours are found by comparing them with
    every entry in tasks. Each true neighbour's place in the walk is the number of entries
    in the cells up to its own; the answer is the quantile of these places.
    """
    some = asked.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id")).limit(CALIBRATION_QUERIES).toArrow()
    ids, q = some["vec_id"].to_numpy(), vectors.matrix(some["vec"].combine_chunks(), dim)
    shared = placed.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        for batch in batches:
            if batch.num_rows:
                score = x @ vectors.matrix(batch["vec"], dim).T
                score[own[:, None] == batch["vec_id"].to_numpy()[None, :]] = -np.inf
                top = np.argpartition(-score, min(k, score.shape[1]) - 1, 1)[:, :k]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(len(own)), top.shape[1]), pa.int32()),
                    pa.array(np.take_along_axis(score, top, 1).ravel()),
                    batch["x"].take(pa.array(top.ravel())), batch["y"].take(pa.array(top.ravel())),
                ], ["q", "score", "x", "y"])

    near = placed.mapInArrow(best, "q int, score double, x int, y int").where("score > double('-infinity')")
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    truth = near.withColumn("r", F.row_number().over(order)).where(f"r <= {k}").select("q", "x", "y").collect()
    if not truth:
        return count
    cells: dict[int, list[int]] = {}
    for r in truth:
        cells.setdefault(r["q"], []).append(r["x"] * len(index.right) + r["y"])
    places = []
    for i, own in cells.items():
        a, b = index.distances(q[i])
        walk = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")
        depth = np.zeros(len(walk), np.int64)
        depth[walk] = np.cumsum(index.sizes.ravel()[walk])
        places.extend(depth[own])
    places = np.sort(places)
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))])


def blocks_of(sizes: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The block of each cell within its left centroid, and over how many divisions a cell's entries are dealt.

    Neighbouring right centroids share a block until it would hold more than ``most``
    entries; a cell of more is a block of its own and divided.
    """
    block, divisions = np.zeros(sizes.shape, np.int32), np.maximum(1, -(-sizes // most)).astype(np.int32)
    at, held = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
    for y in range(sizes.shape[1]):
        opens = (held > 0) & (held + sizes[:, y] > most)
        at, held = at + opens, np.where(opens, 0, held) + sizes[:, y]
        block[:, y] = at
    return block, divisions


def _rerank(placed: DataFrame, asked: DataFrame, index: MultiIndex, dim: int, enough: int, k: int) -> DataFrame:
    """Compare each query with the entries of its cells and keep the best.

    Entries are grouped by blocks of neighbouring cells. A query goes to the blocks that
    hold a cell of its walk, with the cells it wants there as bits, and is compared with the
    entries of these cells only. A block that many queries reach is copied for parts of them.
    """
    block, divisions = blocks_of(index.sizes)
    shared = placed.sparkSession.sparkContext.broadcast((index, block, divisions))
    width = -(-len(index.right) // 8)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, divided = shared.value
        for batch in batches:
            rows = []
            for vec_id, v, q in zip(batch["vec_id"].to_pylist(), batch["vec"].to_pylist(), batch["q"].to_pylist()):
                for x, ys in own.probe(np.frombuffer(v), enough).items():
                    ys = np.array(ys)
                    for b in np.unique(at[x, ys]).tolist():
                        some = ys[at[x, ys] == b]
                        want = np.zeros(width * 8, np.uint8)
                        want[some] = 1
                        rows.extend((vec_id, v, q, x, b, d, np.packbits(want).tobytes()) for d in range(int(divided[x, some].max())))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["vec_id", "vec", "q", "x", "block", "division", "want"])

    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // QUERIES_A_TASK))
    probes = asked.repartition(tasks, F.xxhash64("vec_id")).withColumn("q", F.xxhash64("vec")).mapInArrow(walk, "vec_id long, vec binary, q long, x int, block int, division int, want binary")
    stored, probes = _deal(placed, materialize(probes, "probes"), index.sizes, block, divisions)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = ["query_id", "q", "vec_id", "score"], ([], [], [], [])
        if len(left) and len(right):
            left = left.sort_by("y")
            ids, own, y, mark = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["y"].to_numpy(), right["q"].to_numpy()
            e, q = vectors.matrix(left["vec"].combine_chunks(), dim), vectors.matrix(right["vec"].combine_chunks(), dim)
            want = np.unpackbits(np.frombuffer(b"".join(right["want"].to_pylist()), np.uint8).reshape(-1, width), axis=1).astype(bool)
            first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            for i in range(0, len(own), 256):
                score = np.full((len(own[i : i + 256]), len(ids)), -np.inf)
                for a, b in zip(first, [*first[1:], len(y)]):
                    some = np.flatnonzero(want[i : i + 256, y[a]])
                    if len(some):
                        score[some, a:b] = q[i + some] @ e[a:b].T
                score[own[i : i + 256, None] == ids[None, :]] = -np.inf
                least = np.partition(score, -k, 1)[:, -k] if len(ids) > k else np.full(len(score), -np.inf)
                for r, bound in enumerate(least.tolist()):
                    at = np.flatnonzero((score[r] >= bound - 1e-9 * abs(bound)) & (score[r] > -np.inf)) if bound > -np.inf else np.flatnonzero(score[r] > -np.inf)
                    exact = (e[at] * q[i + r]).sum(1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out[0].append(np.full(len(best), own[i + r]))
                    out[1].append(np.full(len(best), mark[i + r]))
                    out[2].append(ids[at][best])
                    out[3].append(exact[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table([*(join(o, pa.int64()) for o in out[:3]), join(out[3], pa.float64())], names)

    group = ["x", "block", "division", "part"]
    scored = stored.groupBy(*group).cogroup(probes.groupBy(*group)).applyInArrow(compare, "query_id long, q long, vec_id long, score double")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def _deal(placed: DataFrame, probes: DataFrame, sizes: np.ndarray, block: np.ndarray, divisions: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Entries and queries with the block of their cells, its division (of the entries) and part (of the queries).

    Entries of blocks that no query reaches go.
    """
    x, y = np.nonzero(sizes)
    cells = pa.table({"x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()), "block": pa.array(block[x, y]), "divisions": pa.array(divisions[x, y])})
    cells = if_small(placed.sparkSession.createDataFrame(cells))  # one row per cell that holds an entry
    reach = materialize(probes.groupBy("x", "block").agg(F.ceil(F.count("*") / F.max(F.col("division") + 1) / BLOCK).alias("parts")), "reach")
    reach = if_small(reach)
    stored = (
        placed.join(cells, ["x", "y"]).withColumn("division", F.pmod(F.xxhash64("vec_id"), F.col("divisions")).cast("int"))
        .join(reach, ["x", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    )
    asked = probes.join(reach, ["x", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")))
    return stored.select("x", "block", "division", "part", "y", "vec_id", "vec"), asked.drop("parts")
