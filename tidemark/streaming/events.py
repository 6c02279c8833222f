"""Extras on the event stream: windowed counts with a watermark, and a stateful last-seen table. The batch operators have no part in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder of Parquet files as a stream; ``ts`` is taken as UTC."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; events later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
