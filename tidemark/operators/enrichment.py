"""Growth, trailing sums and flags for flow series, and their kin for instants.

Everything about one series is computed by window functions over one partitioning, so a
table of any size is shuffled once, to tasks of a bounded number of rows. Rows of a fiscal quarter are found by a range frame over
a running quarter number; where fiscal fields are missing, dates stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import growth
from tidemark.session import SERIES_A_TASK, dealt

#: The gaps in days that make rows comparable, and the nominal lengths.
QUARTER_GAP = (60, 130)
YEAR_GAP = (320, 410)
TTM_SPAN = (240, 430)
YEAR_DAYS, QUARTER_DAYS = 365, 91

STRICT, DATED = "strict_fiscal_quarter", "comparable_date_gap"
STRICT_WINDOW = "strict_fiscal_quarters"


def fiscal_index(year: Column, quarter: Column) -> Column:
    """Quarters counted through the years; null where either field is."""
    return year * 4 + quarter - 1


def _indexed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__idx``, ``__day``, and ``__own``: whether the row stands for its fiscal quarter (the last by end does)."""
    rows = rows.withColumn("__idx", fiscal_index(F.col("fiscal_year"), F.col("fiscal_quarter"))).withColumn("__day", F.unix_date("end"))
    same = Window.partitionBy(*keys, "__idx").orderBy(F.desc("end"), F.desc("val"))
    return rows.withColumn("__own", F.col("__idx").isNotNull() & (F.row_number().over(same) == 1))


def _match(kind: str, found: Column, fields: list[str]) -> Column:
    return F.when(found.isNotNull(), F.struct(F.lit(kind).alias("kind"), *[found[f].alias(f) for f in fields]))


def _by_quarter(keys: list[str], back: int, fields: list[str]) -> Column:
    """The row that stands for the quarter ``back`` quarters ago, as a struct."""
    w = Window.partitionBy(*keys).orderBy("__idx").rangeBetween(-back, -back)
    return F.when(F.col("__idx").isNotNull(), F.max(F.when(F.col("__own"), F.struct(*fields))).over(w))


def _by_year_gap(keys: list[str], fields: list[str]) -> Column:
    """Of the rows 320 to 410 days back the one nearest to 365, the later one if two are as near."""
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-YEAR_GAP[1], -YEAR_GAP[0])
    near = F.collect_list(F.when(F.col("val").isNotNull(), F.struct(*fields))).over(w)
    gap = lambda x: F.col("__day") - F.unix_date(x["end"])
    return F.array_min(F.transform(near, lambda x: F.struct(F.abs(gap(x) - YEAR_DAYS).alias("far"), gap(x).alias("gap"), x.alias("row"))))["row"]


def enrich_flow(rows: DataFrame, adjusted_metrics: tuple[str, ...] = ("revenue",), keys: tuple[str, ...] = ("cik", "metric_key")) -> DataFrame:
    """Adds growth, trailing and duration-adjusted columns, their sources, flags and the enriched effective date.

    ``rows`` needs cik, metric_key, val, start, end, effective_date, duration_days,
    fiscal_year and fiscal_quarter. Units aren't told apart: a series that mixes them is one
    series; pass ``unit`` in ``keys`` to split it. Null values give null results; an empty
    table gives an empty one; ``adjusted_metrics`` names the metrics whose growth is also
    computed on values scaled to 91 days.
    """
    keys = list(keys)
    adjusted = F.when(F.col("metric_key").isin(*adjusted_metrics) & (F.col("duration_days") > 0), F.col("val") / F.col("duration_days") * QUARTER_DAYS)
    df = _indexed(dealt(rows, SERIES_A_TASK, *keys), keys).withColumn("duration_adjusted_val", adjusted)
    df = _trailing(df, keys)
    base = ["end", "val", "effective_date", "duration_adjusted_val", "ttm_val", "duration_adjusted_ttm_val", "ttm_source_kind", "__ttm_start", "__ttm_end", "__ttm_known"]
    strict, dated = _by_quarter(keys, 4, base), _by_year_gap(keys, base)
    df = df.withColumn("__s", strict).withColumn("__d", dated)
    df = df.withColumn("__year", F.coalesce(_match(STRICT, F.col("__s"), base), _match(DATED, F.col("__d"), base)))
    year = F.col("__year")
    df = df.withColumn("yoy", growth(F.col("val"), year["val"])).withColumn(
        "duration_adjusted_yoy", growth(F.col("duration_adjusted_val"), year["duration_adjusted_val"])
    )
    df = _previous(df, keys, ["end", "val", "effective_date", "duration_adjusted_val", "__idx", "yoy", "duration_adjusted_yoy"], fiscal=True)
    prev = F.col("__prev")
    fiscal_only = lambda c: F.when(prev["__idx"].isNotNull(), prev[c])
    df = (
        df.withColumn("qoq", growth(F.col("val"), prev["val"]))
        .withColumn("duration_adjusted_qoq", growth(F.col("duration_adjusted_val"), prev["duration_adjusted_val"]))
        .withColumn("yoy_delta", F.col("yoy") - fiscal_only("yoy"))
        .withColumn("duration_adjusted_yoy_delta", F.col("duration_adjusted_yoy") - fiscal_only("duration_adjusted_yoy"))
        .withColumn("ttm_yoy", growth(F.col("ttm_val"), year["ttm_val"]))
        .withColumn("ttm_delta", F.col("ttm_val") - year["ttm_val"])
        .withColumn("duration_adjusted_ttm_yoy", growth(F.col("duration_adjusted_ttm_val"), year["duration_adjusted_ttm_val"]))
        .withColumn("duration_adjusted_ttm_delta", F.col("duration_adjusted_ttm_val") - year["duration_adjusted_ttm_val"])
        .withColumn("rolling4_avg", F.col("ttm_val") / 4)
        .withColumn("duration_adjusted_rolling4_avg", F.col("duration_adjusted_ttm_val") / 4)
        .withColumn("is_turnaround", (year["val"] < 0) & (F.col("val") > 0))
        .withColumn("is_deterioration", (year["val"] > 0) & (F.col("val") < 0))
        .withColumn("is_loss_narrowing", (year["val"] < 0) & (F.col("val") < 0) & (F.col("val") > year["val"]))
    )
    both_strict = (F.col("ttm_source_kind") == STRICT_WINDOW) & (year["ttm_source_kind"] == STRICT_WINDOW)
    only = lambda c, x: F.when(F.col(c).isNotNull(), x)
    df = (
        df.withColumn("yoy_source_kind", only("yoy", year["kind"])).withColumn("yoy_base_period_end", only("yoy", year["end"]))
        .withColumn("qoq_source_kind", only("qoq", prev["kind"])).withColumn("qoq_base_period_end", only("qoq", prev["end"]))
        .withColumn("ttm_window_start", only("ttm_val", F.col("__ttm_start"))).withColumn("ttm_window_end", only("ttm_val", F.col("__ttm_end")))
        .withColumn("ttm_yoy_source_kind", only("ttm_yoy", F.when(both_strict, STRICT_WINDOW).otherwise(DATED)))
        .withColumn("ttm_yoy_base_window_start", only("ttm_yoy", year["__ttm_start"])).withColumn("ttm_yoy_base_window_end", only("ttm_yoy", year["__ttm_end"]))
        .withColumn("effective_date", F.greatest("effective_date", prev["effective_date"], year["effective_date"], "__ttm_known", year["__ttm_known"]))
    )
    return df.withColumn("ttm_source_kind", only("ttm_val", F.col("ttm_source_kind"))).drop(*[c for c in df.columns if c.startswith("__")])


def _trailing(df: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of four quarters: by fiscal numbers, else of four rows in a row whose gaps fit."""
    fiscal = Window.partitionBy(*keys).orderBy("__idx").rangeBetween(-3, 0)
    dated = Window.partitionBy(*keys).orderBy("end")
    four, three = dated.rowsBetween(-3, 0), dated.rowsBetween(-2, 0)
    own = F.col("__own") & F.col("val").isNotNull()
    df = df.withColumn("__strict", F.col("__idx").isNotNull() & (F.sum(own.cast("int")).over(fiscal) == 4))
    gap = F.date_diff("end", F.lag("end").over(dated))
    df = df.withColumn("__gap", gap.between(*QUARTER_GAP)).withColumn("__span", F.date_diff("end", F.lag("end", 3).over(dated)))
    chained = F.col("__span").between(*TTM_SPAN) & F.min("__gap").over(three) & (F.count("__gap").over(three) == 3)
    df = df.withColumn("__chain", F.coalesce(chained, F.lit(False)))

    def total(c: str) -> Column:
        strict = F.when(F.count(F.when(own, F.col(c))).over(fiscal) == 4, F.sum(F.when(own, F.col(c))).over(fiscal))
        chain = F.when(F.count(c).over(four) == 4, F.sum(c).over(four))
        return F.when(F.col("__strict"), strict).when(F.col("__chain"), chain)

    def over(fn, c: str) -> Column:
        return F.when(F.col("__strict"), fn(F.when(own, F.col(c))).over(fiscal)).when(F.col("__chain"), fn(F.col(c)).over(four))

    return (
        df.withColumn("ttm_val", total("val")).withColumn("duration_adjusted_ttm_val", total("duration_adjusted_val"))
        .withColumn("ttm_source_kind", F.when(F.col("__strict"), STRICT_WINDOW).when(F.col("__chain"), DATED))
        .withColumn("__ttm_start", over(F.min, "end")).withColumn("__ttm_end", over(F.max, "end")).withColumn("__ttm_known", over(F.max, "effective_date"))
    )


def _previous(df: DataFrame, keys: list[str], fields: list[str], fiscal: bool) -> DataFrame:
    """Adds ``__prev``: the quarter before by fiscal number, else the row before within 60 to 130 days."""
    before = F.lag(F.struct(*fields)).over(Window.partitionBy(*keys).orderBy("end"))
    df = df.withColumn("__b", before)
    dated = F.when(F.date_diff("end", F.col("__b")["end"]).between(*QUARTER_GAP), F.col("__b"))
    strict = _by_quarter(keys, 1, fields) if fiscal else F.lit(None).cast(df.schema["__b"].dataType)
    df = df.withColumn("__s", strict).withColumn("__d", dated)
    return df.withColumn("__prev", F.coalesce(_match(STRICT, F.col("__s"), fields), _match(DATED, F.col("__d"), fields)))


def enrich_instant(rows: DataFrame, keys: tuple[str, ...] = ("cik", "metric_key", "fact_type", "unit")) -> DataFrame:
    """Growth and the mean of four snapshots for instants; units are told apart, there are no trailing sums."""
    keys = list(keys)
    df = _indexed(dealt(rows, SERIES_A_TASK, *keys), keys)
    fields = ["end", "val", "effective_date"]
    df = df.withColumn("__s", _by_quarter(keys, 4, fields)).withColumn("__d", _by_year_gap(keys, fields))
    df = df.withColumn("__year", F.coalesce(_match(STRICT, F.col("__s"), fields), _match(DATED, F.col("__d"), fields)))
    df = df.withColumn("yoy", growth(F.col("val"), F.col("__year")["val"]))
    df = _previous(df, keys, [*fields, "yoy"], fiscal=False)
    year, prev = F.col("__year"), F.col("__prev")
    four = Window.partitionBy(*keys).orderBy("end").rowsBetween(-3, 0)
    mean = F.when(F.count("val").over(four) == 4, F.sum("val").over(four) / 4)
    df = df.withColumn("qoq", growth(F.col("val"), prev["val"])).withColumn("yoy_delta", F.col("yoy") - prev["yoy"]).withColumn("rolling4_avg", mean)
    known = F.when(F.col("rolling4_avg").isNotNull(), F.max("effective_date").over(four))
    only = lambda c, x: F.when(F.col(c).isNotNull(), x)
    df = (
        df.withColumn("__known", known)
        .withColumn("yoy_source_kind", only("yoy", year["kind"])).withColumn("yoy_base_period_end", only("yoy", year["end"]))
        .withColumn("qoq_source_kind", only("qoq", prev["kind"])).withColumn("qoq_base_period_end", only("qoq", prev["end"]))
        .withColumn("effective_date", F.greatest("effective_date", prev["effective_date"], year["effective_date"], "__known"))
    )
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def reliability(rows: DataFrame, tracked: list[str], keys: tuple[str, ...] = ("cik", "metric_key")) -> DataFrame:
    """How far a row can be trusted: observation depth, fiscal continuity and input coverage.

    Depth is min(1, rows so far / 8); continuity the share of steps to the next quarter among
    the last seven transitions whose ends both have fiscal fields; coverage the share of ``tracked`` columns that aren't null.
    """
    w = Window.partitionBy(*keys).orderBy("end")
    step = (fiscal_index(F.col("fiscal_year"), F.col("fiscal_quarter")) - F.lag(fiscal_index(F.col("fiscal_year"), F.col("fiscal_quarter"))).over(w)) == 1
    df = rows.withColumn("__n", F.row_number().over(w)).withColumn("__step", step.cast("double"))
    known = sum((F.col(c).isNotNull().cast("int") for c in tracked), F.lit(0))
    return (
        df.withColumn("observation_depth", F.least(F.lit(1.0), F.col("__n") / 8))
        .withColumn("fiscal_continuity", F.avg("__step").over(w.rowsBetween(-6, 0)))
        .withColumn("input_coverage", known / len(tracked)).drop("__n", "__step")
    )
