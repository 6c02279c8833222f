"""Tasks get a bounded number of rows, however few bytes these are when they are shuffled."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import enrichment, features, signals


def most(df):
    """Rows of the largest task, and of all."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts), sum(counts)


def flows(spark, companies=400, quarters=4):
    return spark.range(companies * quarters).select(
        (F.col("id") / quarters).cast("long").cast("string").alias("cik"), F.lit("revenue").alias("metric_key"), F.lit("flow").alias("fact_type"), F.lit("USD").alias("unit"),
        (F.col("id") % 7).cast("double").alias("val"), F.add_months(F.lit(dt.date(2020, 1, 1)), (F.col("id") % quarters * 3).cast("int")).alias("start"),
        F.add_months(F.lit(dt.date(2020, 3, 31)), (F.col("id") % quarters * 3).cast("int")).alias("end"), F.lit(dt.date(2021, 6, 1)).alias("effective_date"), F.lit(90).alias("duration_days"),
        F.lit(2020).alias("fiscal_year"), (F.col("id") % quarters + 1).cast("int").alias("fiscal_quarter"),
    )


def test_dealt(spark):
    at = session.dealt(spark.range(1000), 50, "id")
    assert at.rdd.getNumPartitions() == 20 and at.count() == 1000
    assert session.dealt(spark.range(3), 50, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    below = spark.range(400).groupBy("id").count()
    assert session.dealt(below, 100, "id").rdd.getNumPartitions() == 5  # not 4, the number of other shuffles
    assert session.dealt(spark.range(0), 50, "id").count() == 0


def test_series_windows(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "SERIES_A_TASK", 40)
    for told in (enrichment.enrich_flow(flows(spark)), enrichment.enrich_instant(flows(spark)), enrichment.reliability(enrichment.enrich_flow(flows(spark)), ["val"])):
        largest, every = most(told)
        assert every == 1600 and largest < 160


def test_feature_windows(spark, monkeypatch):
    monkeypatch.setattr(features, "FEATURES_A_TASK", 40)
    monkeypatch.setattr(signals, "FEATURES_A_TASK", 40)
    day = lambda i: dt.date(2020, 4, 30) + dt.timedelta(days=i // 400)
    rows = spark.createDataFrame(
        [(f"T{i % 400}", f"{i % 400}", "growth", "f", "revenue", "k", float(i), dt.date(2020, 3, 31), day(i)) for i in range(1600)],
        "ticker string, cik string, factor string, axis string, metric_key string, feature_key string, feature_value double, period_end date, effective_date date",
    )
    for told in (features.latest_features(rows), signals.known_spans(rows, [signals.ALL_TIME])):
        largest, every = most(told)
        assert every == 400 and largest < 40
