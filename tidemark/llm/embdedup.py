"""Near-duplicate embeddings by binary codes of a random rotation with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.common import components
from tidemark.session import materialize

LEAST_COSINE = 0.9
#: Bits of a code; vectors are padded with zeros to so many dimensions before the rotation.
BITS = 256
#: The half-width of the confidence interval in standard errors: a pair is wrongly ruled out about once in 100,000.
DEVIATIONS = 4.5
#: Centroids are fitted on a bounded sample of about this many vectors for each.
FIT_PER_CELL, MOST_CELLS = 16, 4096
#: A cell for about so many vectors.
PER_CELL = 4096
#: Rows of a cell are compared in blocks of so many on either side: an eighth of all, within these bounds.
LEAST_BLOCK, BLOCK_VALUES = 1024, 2**19
#: Pairs that are estimated at once.
PAIRS = 2**20


def rotation(dim: int, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of max(dim, bits) columns."""
    size = max(dim, bits)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors and their factors.

    The code is the signs after the rotation; the factor is the inner product of the vector
    with the unit vector its code stands for. For another unit vector q the quotient of
    <code, q> by the factor estimates <vector, q> without bias.
    """
    turned = units @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (coded rows by rotated queries) and each coded row's half-width."""
    size = turned.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :size].astype(np.float32) * 2 - 1
    told = signs @ turned.T.astype(np.float32) / (np.sqrt(size) * factors[:, None])
    return told, DEVIATIONS * np.sqrt(np.maximum(0, 1 - factors**2)) / (factors * np.sqrt(size - 1))


def link(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Equal vectors are one class, compared once, and count as links of each other. A class
    is stored in the cell of its nearest centroid and looks into every cell whose bisecting
    plane with its own is within half the distance of two vectors of cosine ``least``. The
    distances of a pair's ends to the plane between their cells add up to no more than
    their own distance, so at least one end looks into the other's cell, at any number of
    cells. There its rotated vector is set against the stored codes; pairs whose interval lies
    below ``least`` are ruled out, all others are computed in double precision from the
    vectors, so no link is below ``least``. A pair is missed only if the code's bound fails. A cell of many rows is compared
    block by block in as many groups, and tasks return counts and one edge per row, never pairs.

    Vectors that are null, zero, of another length than the commonest, or hold null or
    non-finite components have no links, and rows of a null vec_id neither: these have a null
    component and are kept. Rows that repeat a vec_id with equal vectors count as links of each other; with different
    vectors they share a component, are no links of each other, and each has the links that any of them has with other
    ids and its own copies. Columns other than
    vec_id and embedding are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    dim = vectors.dimension(embeddings)
    rows = materialize(vectors.checked(embeddings, dim), "checked")
    valid = rows.where("vec is not null and vec_id is not null")
    classes = materialize(
        valid.groupBy("h0", "h1").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("vec").alias("vec")), "vector-classes"
    )
    count = classes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(_compare(classes, dim, count, least), "vector-links")
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.where("hub <> vec_id").select(F.col("vec_id").alias("a"), F.col("hub").alias("b")))
    named = (
        classes.select("h0", "h1", "vec_id", "m")
        .join(counted, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    linked = valid.select("vec_id", "h0", "h1").join(named, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compare(classes: DataFrame, dim: int, count: int, least: float) -> DataFrame:
    """vec_id, links (rows linked, copies counted), hub (the smallest vec_id of its local component)."""
    spark = classes.sparkSession
    cells = int(np.clip(count // PER_CELL, 4, MOST_CELLS))
    block = int(np.clip(count // 8, LEAST_BLOCK, max(LEAST_BLOCK, BLOCK_VALUES // dim)))
    fitted = vectors.sample(classes, dim, cells * FIT_PER_CELL, count, "cells")
    if not len(fitted):
        fitted = vectors.sample(classes, dim, cells * FIT_PER_CELL, 1, "cells")
    units = fitted / np.linalg.norm(fitted, axis=1, keepdims=True)
    centres = vectors.kmeans(units, cells, rounds=5)
    shared = spark.sparkContext.broadcast((centres, rotation(dim)))
    half = np.sqrt(max(0.0, 2 - 2 * least)) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.matrix(batch["vec"], dim)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            size = (middle**2).sum(1)
            near = u @ middle.T - size / 2
            home = near.argmax(1)
            # a little more than the distance between centres: rounding must not keep a vector from looking
            apart = np.sqrt(np.maximum(size[home][:, None] + size - 2 * middle[home] @ middle.T, 0) + 1e-12)
            looks = near[np.arange(len(u)), home][:, None] - near <= half * apart + 1e-9
            ends = np.concatenate([[0], np.cumsum(looks.sum(1))])
            codes, factors = encode(u, turn)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], batch["m"], batch["vec"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors),
                pa.array(home, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(looks)[1], pa.int32())),
                pa.array([c.tobytes() for c in np.packbits(looks, axis=1)], pa.binary()),
            ], ["vec_id", "m", "vec", "code", "factor", "home", "cells", "looks"])

    schema = "vec_id long, m long, vec binary, code binary, factor double, home int, cells array<int>, looks binary"
    placed = materialize(classes.select("vec_id", "m", "vec").mapInArrow(place, schema), "coded")
    one = placed.select(F.col("home").alias("cell")).groupBy("cell").agg(F.count("*").alias("stored"))
    all_ = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("looking"))
    # one row per cell, MOST_CELLS at most
    shape = one.join(all_, "cell").select("cell", F.ceil(F.col("stored") / block).cast("int").alias("sb"), F.ceil(F.col("looking") / block).cast("int").alias("lb"))
    shape = F.broadcast(shape)
    stored = (
        placed.withColumn("cell", F.col("home")).join(shape, "cell")
        .withColumn("s", F.pmod(F.xxhash64("vec_id"), F.col("sb")).cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lb") - 1)))
        .select("cell", "s", "l", "vec_id", "m", "vec", "code", "factor", "looks")
    )
    looking = (
        placed.select(
            F.col("vec_id").alias("other"), F.col("m").alias("times"), F.col("vec").alias("query"),
            "home", F.explode("cells").alias("cell"),
        ).join(shape, "cell")
        .withColumn("l", F.pmod(F.xxhash64("other"), F.col("lb")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
        .select("cell", "s", "l", "other", "times", "query", "home")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _links(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        a, b = left["vec_id"].to_numpy(), right["other"].to_numpy()
        x, y = (vectors.matrix(t.combine_chunks(), dim) for t in (left["vec"], right["query"]))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(a), -1)
        m, times, home, factors = left["m"].to_numpy(), right["times"].to_numpy(), right["home"].to_numpy(), left["factor"].to_numpy()
        looks = np.frombuffer(b"".join(left["looks"].to_pylist()), np.uint8).reshape(len(a), -1)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        total, hub = np.zeros(len(nodes)), np.arange(len(nodes))
        step = max(1, PAIRS // len(a))
        for n in range(0, len(b), step):
            some = y[n : n + step]
            told, width = estimate(codes, factors, some @ shared.value[1])
            i, j = np.nonzero(told >= (least - width - 1e-5).astype(np.float32)[:, None])
            keep = a[i] != b[n + j]
            i, j = i[keep], j[keep]
            sure = _reach(x, some, i, j, least)
            i, j = i[sure], j[sure] + n
            if not len(i):
                continue
            # the stored side counts the pair itself, unless it also looks into the other's cell
            own = looks[i, home[j] >> 3] >> (7 - (home[j] & 7)) & 1 == 0
            total += np.bincount(v[j], m[i], len(nodes)) + np.bincount(u[i[own]], times[j[own]], len(nodes))
            hub = _joined(hub, u[i], v[j])
        met = (total > 0) | (hub != np.arange(len(nodes)))
        return _links(nodes[met], total[met].astype(np.int64), nodes[hub[met]])

    return stored.groupBy("cell", "s", "l").cogroup(looking.groupBy("cell", "s", "l")).applyInArrow(compare, "vec_id long, links long, hub long")


def _reach(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether rows ``i`` of ``x`` and ``j`` of ``y`` have at least the inner product ``least``, the same in either order."""
    sure, open_ = np.zeros(len(i), bool), np.arange(len(i))
    if 16 * len(i) > len(x) * len(y):
        # many of all pairs: one product of matrices tells all but those at the limit
        product = (x @ y.T)[i, j]
        sure, open_ = product >= least, np.nonzero(np.abs(product - least) < 1e-9)[0]
    for n in range(0, len(open_), 65536):
        k = open_[n : n + 65536]
        sure[k] = (x[i[k]] * y[j[k]]).sum(1) >= least
    return sure


def _joined(hub: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``hub``, the smallest node of each node's component, after the edges (u, v) are added."""
    hub = hub.copy()
    while True:
        a, b = hub[u], hub[v]
        apart = a != b
        if not apart.any():
            return hub
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(hub, a, b)
        np.minimum.at(hub, b, a)
        while ((up := hub[hub]) != hub).any():
            hub = up


def _links(ids: np.ndarray, links: np.ndarray, hub: np.ndarray) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(hub, pa.int64())], ["vec_id", "links", "hub"])
