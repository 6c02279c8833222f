"""Validators of metric series: each gives issues (cik, metric_key, end, check, severity); a report counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("cik", "metric_key", "end", "check", "severity")


def _issue(rows: DataFrame, when: Column, check: str, severity: str) -> DataFrame:
    return rows.where(when).select("cik", "metric_key", "end", F.lit(check).alias("check"), F.lit(severity).alias("severity"))


def _all(parts: list[DataFrame]) -> DataFrame:
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    return told


def chronology(rows: DataFrame) -> DataFrame:
    """Periods that repeat or overlap the one before; fiscal numbers that don't grow with time."""
    w = Window.partitionBy("cik", "metric_key", "unit").orderBy("end", "start")
    index = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    df = rows.withColumn("__e", F.lag("end").over(w)).withColumn("__s", F.lag("start").over(w)).withColumn("__i", F.last(index, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same = (F.col("__e") == F.col("end")) & F.col("__s").eqNullSafe(F.col("start"))
    return _all([
        _issue(df, same, "duplicate_period", "error"), _issue(df, ~same & (F.col("start") <= F.col("__e")), "overlapping_period", "warning"),
        _issue(df, index <= F.col("__i"), "non_monotonic_period", "error"),
    ])


def quality(rows: DataFrame) -> DataFrame:
    """Null values, impossible lengths, unknown period types, impossible years."""
    return _all([
        _issue(rows, F.col("val").isNull() | F.isnan("val"), "null_value", "error"), _issue(rows, ~F.col("duration_days").between(0, 400), "duration_out_of_range", "warning"),
        _issue(rows, ~F.col("period_type").isin("annual", "quarter", "instant"), "bad_period_type", "error"), _issue(rows, ~F.col("fiscal_year").between(1900, 2100), "year_out_of_range", "error"),
    ])


def integrity(rows: DataFrame) -> DataFrame:
    """Missing or impossible fiscal fields, ends before starts."""
    flow = F.col("period_type") == "quarter"
    return _all([
        _issue(rows, F.col("fiscal_year").isNull(), "missing_fiscal_year", "warning"), _issue(rows, flow & F.col("fiscal_quarter").isNull(), "missing_fiscal_quarter", "warning"),
        _issue(rows, ~F.col("fiscal_quarter").between(1, 4), "bad_fiscal_quarter", "error"), _issue(rows, F.col("end") < F.col("start"), "end_before_start", "error"),
    ])


def coverage(rows: DataFrame) -> DataFrame:
    """Quarters that a series lacks between its first and its last fiscal quarter; one issue each, at the quarter's calendar end."""
    index = F.col("fiscal_year") * 4 + F.col("fiscal_quarter") - 1
    known = rows.where(index.isNotNull()).select("cik", "metric_key", index.alias("i")).distinct()
    bounds = known.groupBy("cik", "metric_key").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    wanted = bounds.select("cik", "metric_key", F.explode(F.sequence("a", "b")).alias("i"))
    lost = wanted.join(known, ["cik", "metric_key", "i"], "left_anti")
    end = F.last_day(F.make_date(F.floor(F.col("i") / 4).cast("int"), (F.col("i") % 4 * 3 + 3).cast("int"), F.lit(1)))
    return lost.select("cik", "metric_key", end.alias("end"), F.lit("missing_quarter").alias("check"), F.lit("warning").alias("severity"))


def flow_consistency(annual: DataFrame, quarters: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Years that differ by more than a tenth from the sum of their quarters, of which there are three or more."""
    summed = quarters.where("fiscal_year is not null").groupBy("cik", "metric_key", "fiscal_year").agg(F.sum("val").alias("q"), F.count("val").alias("n")).where("n >= 3")
    both = annual.join(summed, ["cik", "metric_key", "fiscal_year"])
    return _issue(both, F.abs(F.col("val") - F.col("q")) > tolerance * F.greatest(F.abs("val"), F.lit(1e-9)), "annual_differs_from_quarters", "warning")


def negatives(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Negative values: a conflict where the sign profile is positive, else information. ``profiles`` (cik, metric_key, kind)."""
    told = rows.join(profiles.select("cik", "metric_key", "kind"), ["cik", "metric_key"], "left").where("val < 0")
    return _all([_issue(told, F.col("kind") == "positive", "sign_profile_conflict", "warning"), _issue(told, ~F.col("kind").eqNullSafe("positive"), "negative_value", "info")])


def report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("metric_key", "check", "severity").agg(F.count("*").alias("n"), F.countDistinct("cik").alias("companies"))
