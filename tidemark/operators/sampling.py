"""Seeded samples that don't depend on how rows are spread, and can be put together from samples of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: str) -> Column:
    """The lot of a row: the same for equal keys and seeds wherever the row is."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def bottom_k(rows: DataFrame, keys: list[str], item: str, k: int, seed: str = "sample") -> DataFrame:
    """Per group of ``keys`` the ``k`` rows with the smallest lots of ``item``, with ``lot`` and ``place`` from 1.

    Items of a group should be different; equal ones have equal lots, and then the other columns decide. Each task keeps no
    more than ``k`` rows a group before anything is shuffled. Null items have no lot and aren't drawn.
    """
    some = rows.withColumn("lot", draw(F.col(item), seed)).where("lot is not null")
    rest = [F.col(c) for c in rows.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy("lot", *rest)
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def merged(a: DataFrame, b: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The sample of the rows behind two samples of the same seed and at least ``k``: no other row is looked at."""
    both = a.drop("place").unionByName(b.drop("place"))
    w = Window.partitionBy(*keys).orderBy("lot", *[F.col(c) for c in both.columns if c not in (*keys, "lot")])
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
