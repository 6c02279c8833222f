"""Tables laid out for reading by company: bucketed and sorted by cik, so a company is in one bucket and joins move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: A bucket holds about so many rows of the largest table.
BUCKET_ROWS = 2_000_000
#: The fewest buckets: a lookup reads one of them.
LEAST_BUCKETS = 8


class ServingTables:
    """Several tables bucketed alike by cik. ``write`` once; ``table`` and ``lookup`` read; ``drop`` removes them.

    Rows without a cik can't be looked up by company and are kept in their table. All tables have the buckets that the
    largest needs, so that any two of them join bucket by bucket.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path or scratch_path(spark, "serving"), buckets
        self.prefix = f"serving_{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}

    def write(self, **tables: DataFrame) -> ServingTables:
        n = self.buckets or max(LEAST_BUCKETS, -(-max(t.count() for t in tables.values()) // BUCKET_ROWS))
        for name, rows in tables.items():
            own = f"{self.prefix}_{name}"
            # a task writes whole buckets: one file each
            rows.repartition(n, "cik").write.mode("overwrite").bucketBy(n, "cik").sortBy("cik").option("path", f"{self.path}/{name}").saveAsTable(own)
            self.names[name] = own
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def lookup(self, name: str, cik: str, **equal: str) -> DataFrame:
        """A company's rows: one bucket is read, and of it what may hold the cik."""
        rows = self.table(name).where(F.col("cik") == cik)
        for column, value in equal.items():
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows

    def drop(self) -> None:
        for own in self.names.values():
            self.spark.sql(f"drop table if exists {own}")
        self.names = {}


def overview(profiles: DataFrame, features: DataFrame, signals: DataFrame) -> DataFrame:
    """One row a company: its profile, latest features and latest signals as sorted arrays of structs, with evidence within.

    ``profiles`` has a row a cik; ``features`` and ``signals`` may have a history, of which the latest by effective date and
    period end counts. Companies without features or signals have empty arrays. Over :class:`ServingTables` no step shuffles.
    """
    newest = [F.desc("effective_date"), F.desc("period_end"), "ticker"]
    first = lambda df, keys: df.withColumn("__r", F.row_number().over(Window.partitionBy("cik", *keys).orderBy(*newest))).where("__r = 1")
    gather = lambda df, columns, name: df.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    shown = ["factor", "axis", "metric_key", "feature_key", "feature_value", "period_end", "effective_date"]
    own = gather(first(features.where("feature_value is not null"), shown[:4]), shown, "features")
    told = ["factor", "axis", "signal_key", "signal_value", "confidence", "period_end", "effective_date", "supporting", "contradicting"]
    states = gather(first(signals, ["factor", "axis"]), told, "signals")
    joined = profiles.join(own, "cik", "left").join(states, "cik", "left")
    empty = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    return joined.select(*profiles.columns, empty("features", own), empty("signals", states))
