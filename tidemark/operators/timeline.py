"""Turnover of cores, event bands, forward returns and cohorts along a timeline of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.relational import first_on_or_after
from tidemark.session import if_small

#: The bands' thresholds and the windows in months.
WATCH, REGIME, WATCH_RANK, REGIME_RANK = 4 / 7, 0.75, 0.8, 0.9
WINDOWS = (1, 3, 6, 12)


def set_turnover(a: Column, b: Column) -> Column:
    """1 less the Jaccard similarity of two arrays; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a, b)) / union)


def weighted_turnover(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turnover): 1 less the sum of smaller over the sum of larger shares of (keys, name, share)."""
    both = a.withColumnRenamed("share", "x").join(b.withColumnRenamed("share", "y"), [*keys, "name"], "full")
    low, high = F.least(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))), F.greatest(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)))
    return both.groupBy(*keys).agg((1 - F.sum(low) / F.sum(high)).alias("turnover"))


def cores(ranked: DataFrame, n: int = 5) -> DataFrame:
    """(as_of, core): the names of the ``n`` best ranked of (as_of, rank, name), in order."""
    few = ranked.where(F.col("rank") <= n).groupBy("as_of").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("r"))
    return few.select("as_of", F.transform("r", lambda x: x["name"]).alias("core"))


def core_changes(core: DataFrame, back: int = 1) -> DataFrame:
    """Adds ``turnover`` against the core ``back`` snapshots before; snapshots are few, one row each."""
    w = Window.orderBy("as_of")
    return core.withColumn("turnover", set_turnover(F.col("core"), F.lag("core", back).over(w)))


def event_bands(changes: DataFrame) -> DataFrame:
    """``regime``, ``watch`` or null: by fixed thresholds or by nearest-rank percentiles of all turnovers."""
    told = changes.agg(
        F.expr(f"percentile_disc({WATCH_RANK}) within group (order by turnover)").alias("p_watch"), F.expr(f"percentile_disc({REGIME_RANK}) within group (order by turnover)").alias("p_regime")
    )
    t = F.col("turnover")
    band = F.when((t >= REGIME) | (t >= F.col("p_regime")), "regime").when((t >= WATCH) | (t >= F.col("p_watch")), "watch")
    return changes.crossJoin(F.broadcast(told)).withColumn("band", F.when(t > 0, band)).drop("p_watch", "p_regime")


def forward_returns(members: DataFrame, bars: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(as_of, ticker, months, base_date, end_date, forward_return) from the first bar on or after each date.

    Months run over their end (31 January plus one is 2 or 3 March). A window that has no bar
    yet, or whose bar has no valid close, has no row.
    """
    steps = F.array(*[F.lit(m) for m in (0, *windows)])
    dates = members.select("as_of", "ticker").distinct().withColumn("months", F.explode(steps)).withColumn("target", cal.add_months_overflow(F.col("as_of"), F.col("months")))
    priced = first_on_or_after(dates, bars, ["ticker"], "target", "price_date", "close")
    base = priced.where("months = 0").select("as_of", "ticker", F.col("price_date").alias("base_date"), F.col("close").alias("base_close"))
    ends = priced.where("months > 0").select("as_of", "ticker", "months", F.col("price_date").alias("end_date"), "close")
    return ends.join(base, ["as_of", "ticker"]).select("as_of", "ticker", "months", "base_date", "end_date", (F.col("close") / F.col("base_close") - 1).alias("forward_return"))


def return_summary(returns: DataFrame, keys: tuple[str, ...] = ("as_of", "months")) -> DataFrame:
    return returns.groupBy(*keys).agg(F.count("forward_return").alias("n"), F.avg("forward_return").alias("mean"), F.median("forward_return").alias("median"))


def cohorts(summary: DataFrame, events: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Event against other snapshots: the mean of snapshot means, the median of them, and the excess over the benchmark."""
    told = summary.join(if_small(events.select("as_of", F.col("band").isNotNull().alias("is_event"))), "as_of")
    told = told.join(benchmark.select("as_of", "months", F.col("forward_return").alias("b")), ["as_of", "months"], "left")
    return told.groupBy("is_event", "months").agg(
        F.count("*").alias("snapshots"), F.avg("mean").alias("mean"), F.median("mean").alias("median"), F.avg(F.col("mean") - F.col("b")).alias("excess")
    )


def covered_dates(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """Dates at which every factor and axis has at least ``least`` of the entities of the last date, and a directional state."""
    told = signals.groupBy("as_of", "factor", "axis").agg(F.countDistinct("entity").alias("n"), F.countDistinct(F.when(~F.col("signal_key").startswith("mixed_"), F.col("signal_key"))).alias("directional"))
    last = told.groupBy("factor", "axis").agg(F.max_by("n", "as_of").alias("latest"))
    axes = last.count()
    good = told.join(if_small(last), ["factor", "axis"]).where((F.col("n") >= F.col("latest") * least) & (F.col("directional") > 0))
    return good.groupBy("as_of").agg(F.count("*").alias("axes")).where(F.col("axes") == axes)


def changed_entities(outputs: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Keys whose inputs are newer than their outputs, or that have none: (key, input_at, output_at)."""
    newest = inputs.groupBy(key).agg(F.max("updated_at").alias("input_at"))
    built = outputs.groupBy(key).agg(F.max("updated_at").alias("output_at"))
    return newest.join(built, key, "left").where(F.col("output_at").isNull() | (F.col("input_at") > F.col("output_at")))
