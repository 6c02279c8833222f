"""What the training-data operators share: reading, checked broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, materialize, row_count_at_most

#: The white space that separates words, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of keys with at most so many rows may be broadcast (8 bytes a key: about 8 MB).
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if a count shows that it is within ``limit`` rows."""
    return F.broadcast(df) if row_count_at_most(df, limit) else df


#: Edges whose components a task finds at once.
EDGES_AT_ONCE = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges, each node but a component's smallest with that one (hi, lo)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo) with the same components, in each task no more than its nodes; longs without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [] if batch is None else [batch]
            if held and (batch is None or sum(x.num_rows for x in held) >= EDGES_AT_ONCE):
                found = stars(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("hi", "lo")))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["hi", "lo"])
                held = []

    return edges.mapInArrow(run, "hi long, lo long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) for each node named.

    ``component`` is the smallest node reachable. EDGES_AT_ONCE edges or fewer, by a count, are what a task holds anyway and
    take one. Of more, tasks first contract the edges they hold; alternating large-star and small-star steps turn what is left
    into a star around each component's smallest node in a logarithmic number of rounds, none if it is stars already; each
    round is two aggregations and a written table. Self-loops and null ends are ignored; no edge gives no row. ``edges`` are
    read more than once, so they should be a table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo"))
    small = row_count_at_most(pairs, EDGES_AT_ONCE)
    current = materialize(_contracted(pairs.coalesce(1) if small else _contracted(pairs).distinct()), label)
    # rows of one partition are made distinct without a shuffle
    current = current.coalesce(1) if small else current
    while not small and not _are_stars(current):
        both = current.union(current.select("lo", "hi"))
        near = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(near, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        low = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct()
        )
        following = materialize(_contracted(low), label)
        discard(current)
        current = following
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each hi has one lo, which is no hi itself: then every component is a star around its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return seen.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, given :data:`CRC_TABLE` joined as ``tab``."""
    units = f"list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {units}), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"


#: A common table expression of the 256 values of CRC-32, by its rule.
CRC_TABLE = """tab as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i))"""
