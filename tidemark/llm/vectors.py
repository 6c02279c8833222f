"""What both vector operators need: checked vectors, copies, and k-means on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import mixed

_PLACE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def dimension(vectors: DataFrame) -> int:
    """The commonest length of an embedding (the smaller, if two are as common); 0 for an empty table."""
    row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, h0, h1 and the vector as bytes of doubles; h0 and h1 tell equal vectors.

    ``vec`` is null where a vector takes no part: null, of another length than ``dim``,
    zero, or holding null or non-finite components. A negative zero counts as zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["embedding"]
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
            x = np.full((len(column), dim), np.nan)
            if right.any():
                flat = pc.list_flatten(column.filter(pa.array(right))).cast(pa.float64())
                x[right] = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1) if dim else np.zeros(len(x), bool)
            x = np.where(ok[:, None], x, 0.0) + 0.0
            bits = mixed(x.view(np.uint64).reshape(x.shape) + _PLACE[:dim]) if dim else np.zeros((len(x), 0), np.uint64)
            h0 = mixed((bits * _PLACE[:dim]).sum(1, dtype=np.uint64)).view(np.int64)
            h1 = mixed((bits ^ (bits >> np.uint64(17))).sum(1, dtype=np.uint64)).view(np.int64)
            vec = pa.array([r.tobytes() if k else None for r, k in zip(x, ok)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), pa.array(h0), pa.array(h1), vec], ["vec_id", "h0", "h1", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, h0 long, h1 long, vec binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of doubles as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def sample(rows: DataFrame, dim: int, most: int, count: int, seed: str) -> np.ndarray:
    """About ``most`` vectors by a hash of vec_id, or all if there are fewer: what models are fitted on."""
    share = min(1.0, most / max(count, 1))
    coin = F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.lit(1_000_000)) / 1e6
    some = rows.where(F.col("vec").isNotNull() & (coin < share)).select("vec_id", "vec").toArrow()
    x = matrix(some["vec"].combine_chunks(), dim) if len(some) else np.zeros((0, dim))
    return x[np.argsort(some["vec_id"].to_numpy(zero_copy_only=False), kind="stable")] if len(x) else x


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centroids of at most ``k`` clusters of the rows of ``x``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """The place of the nearest centre for each row."""
    half = (centres**2).sum(1) / 2
    parts = [(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
