"""Metric series from mapped facts: periods resolved, quarters rebuilt and merged, one best row per period, years summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import duration_days
from tidemark.functions.filings import fiscal_year, period_quarter
from tidemark.operators import periods
from tidemark.session import materialize

FLOW_KINDS = ("flow", "per_share", "share_count")
#: What a window's basis and match add to a candidate's fit, and which sources are preferred.
BASIS_POINTS, MATCH_POINTS = 15, {"exact": 25, "near": 15, "partial": 5, "outside": -10}
SOURCE_ORDER = ("raw_direct", "segment_merged", "other_merged", "cumulative_derived", "annual_derived", "raw_partial")
#: How far merged segments may miss a quarter's window in days, and forms too weak to rebuild a quarter from.
SEGMENT_DAYS, WEAK_FORMS = 7, ("8-K", "6-K")

SERIES = ["cik", "metric_key"]
STATED = [*SERIES, "tag", "unit"]
LABELS = ["fy", "fp", "form", "frame"]
#: What every candidate has before its period is resolved.
ROW = [*STATED, "fact_type", "priority", "start", "end", "val", "filed", "accn", *LABELS]


def candidates(facts: DataFrame, years: DataFrame, quarters: DataFrame) -> DataFrame:
    """Facts with their period (see :func:`periods.resolve_periods`) and source_kind: raw_direct, or raw_partial where the window is missed."""
    told = periods.resolve_periods(facts.select(*ROW), years, quarters)
    missed = F.col("kind").isin("quarter", "annual", "ytd") & ~F.col("window_match").isin("exact", "near")
    return told.withColumn("source_kind", F.when(missed, "raw_partial").otherwise("raw_direct"))


def from_earlier(rows: DataFrame) -> DataFrame:
    """Quarters as a year or cumulative span less the latest span of the same tag and start that ends before it.

    The span before may be a quarter or cumulative; of several statements of it the last one
    counts. Years stated by a current report are left out. One window per tag and start, so no
    pairs are made. Labels are dropped: the rebuilt dates alone decide the period.
    """
    w = Window.partitionBy(*STATED, "start").orderBy(F.unix_date("end")).rangeBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("kind").isin("quarter", "ytd") & F.col("val").isNotNull(), F.struct("end", "filed", "val"))).over(w)
    # spans of other kinds are neither taken from nor rebuilt
    told = rows.where("start is not null and end is not null and kind in ('quarter', 'ytd', 'annual')").withColumn("p", before).where(F.col("p").isNotNull() & F.col("kind").isin("ytd", "annual"))
    strong = (F.col("kind") == "ytd") | ~F.coalesce(F.upper("form").isin(*WEAK_FORMS), F.lit(False))
    return _rebuilt(told.where(strong), F.date_add("p.end", 1), F.col("end"), F.when(F.col("kind") == "annual", "annual_derived").otherwise("cumulative_derived"))


def from_later(rows: DataFrame) -> DataFrame:
    """Leading quarters as a cumulative span less the quarter of the same tag and end that starts earliest after it."""
    w = Window.partitionBy(*STATED, "end").orderBy(-F.unix_date("start")).rangeBetween(Window.unboundedPreceding, -1)
    after = F.max(F.when((F.col("kind") == "quarter") & F.col("val").isNotNull(), F.struct((-F.unix_date("start")).alias("s"), "filed", "start", "val"))).over(w)
    told = rows.where("start is not null and end is not null and kind in ('quarter', 'ytd')").withColumn("p", after).where(F.col("p").isNotNull() & (F.col("kind") == "ytd"))
    return _rebuilt(told, F.col("start"), F.date_add("p.start", -1), F.lit("cumulative_derived"))


def _rebuilt(told: DataFrame, start, end, source) -> DataFrame:
    names = [c for c in ROW if c not in ("start", "end", "val", *LABELS)]
    rows = told.where(duration_days(start, end).between(*periods.QUARTER_LENGTH)).select(
        *names, start.alias("start"), end.alias("end"), (F.col("val") - F.col("p.val")).alias("val"),
        *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in LABELS], source.alias("source_kind"),
    )
    return rows.where("val is not null").select(*ROW, "source_kind")


def from_segments(rows: DataFrame) -> DataFrame:
    """Partial rows of one filing that follow each other within a day and fill a quarter's window within a week, as their sum."""
    keys = [*STATED, "fact_type", "priority", "accn", "filed", "fiscal_year", "fiscal_quarter", "expected_start", "expected_end"]
    some = rows.where((F.col("kind") == "quarter") & (F.col("source_kind") == "raw_partial") & F.col("fy").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    w = Window.partitionBy(*keys).orderBy("start", "end", "val")
    gap = F.abs(F.date_diff("start", F.lag("end").over(w)) - 1) > 1
    told = some.withColumn("gap", F.coalesce(gap, F.lit(False))).groupBy(*keys).agg(
        F.min("start").alias("start"), F.max(F.struct("start", "end", *LABELS)).alias("l"), F.sum("val").alias("val"), F.count("*").alias("n"), F.bool_or("gap").alias("gap"),
    )
    near = lambda a, b: F.abs(F.date_diff(a, b)) <= SEGMENT_DAYS
    fits = (F.col("n") > 1) & ~F.col("gap") & near(F.col("start"), F.col("expected_start")) & near(F.col("l.end"), F.col("expected_end"))
    return told.where(fits & F.col("val").isNotNull()).withColumns({"end": F.col("l.end"), **{c: F.col(f"l.{c}") for c in LABELS}}).select(*ROW, F.lit("segment_merged").alias("source_kind"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Unresolved spans that follow each other within a day, summed from each chain's start: every prefix of two or more.

    ``chain`` and ``place`` tell them apart; the first prefix whose dates resolve to a quarter
    is the merged quarter. There are no more prefixes than rows.
    """
    by = Window.partitionBy(*SERIES, "unit").orderBy("start", "end", "tag", "accn", "val")
    some = rows.where((F.col("kind") == "other") & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("val").isNotNull())
    fresh = F.when(F.abs(F.date_diff("start", F.lag("end").over(by)) - 1) <= 1, 0).otherwise(1)
    chained = some.withColumn("f", fresh).withColumn("chain", F.sum("f").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*SERIES, "unit", "chain").orderBy("start", "end", "tag", "accn", "val")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    told = chained.withColumns({"place": F.row_number().over(within), "val": F.sum("val").over(upto), "start": F.first("start").over(upto)})
    return told.where("place > 1").select(*ROW, F.lit("other_merged").alias("source_kind"), "chain", "place")


def best_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate per ``keys``: fit of its period, tag priority, filing date, agreement with its labels, source, confidence, accession.

    Fit is 100 times the window's score and 20 times the confidence plus points for the basis
    and the match. What is still equal goes to the larger value, then the later span.
    """
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MATCH_POINTS.items() for x in kv]), F.col("window_match")), F.lit(0))
    fit = F.round(100 * F.col("fit_score") + 20 * F.col("confidence") + points + F.when(F.col("basis").isin("annual_window", "quarter_window"), BASIS_POINTS).otherwise(0), 9)
    year, quarter = fiscal_year(F.col("fy")), period_quarter(F.col("fp"))
    annual = F.col("kind") == "annual"
    agrees = (year == F.col("fiscal_year")) & F.when(annual, F.upper(F.trim("fp")) == "FY").otherwise(quarter == F.col("fiscal_quarter"))
    labelled = year.isNotNull() | F.when(annual, F.col("fp").isNotNull()).otherwise(quarter.isNotNull())
    labels = F.when(F.col("basis").isin("instant_snapshot", "unresolved"), 2).when(agrees, 1).when(labelled, 3).otherwise(2)
    source = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source_kind"))
    order = [fit.desc(), F.asc_nulls_last("priority"), F.desc_nulls_last("filed"), labels.asc(), source.asc(), F.desc("confidence"), F.desc_nulls_last("accn"), F.desc_nulls_last("val"), F.desc("end"), F.desc_nulls_last("start"), "tag", "unit"]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def summed_years(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    """Years without an annual row as the sum of their four best quarters, if those share tag and unit and fit their windows."""
    sound = (F.col("source_kind") != "raw_partial") & F.col("window_match").isin("exact", "near")
    one = quarters.groupBy(*SERIES, "fiscal_year").agg(
        F.count("*").alias("n"), F.bool_and(sound & F.col("val").isNotNull()).alias("sound"), F.min(F.struct("tag", "unit")).alias("a"), F.max(F.struct("tag", "unit")).alias("z"),
        F.max_by(F.struct(*[c for c in quarters.columns if c not in (*SERIES, "fiscal_year")]), "fiscal_quarter").alias("q"), F.min_by("start", "fiscal_quarter").alias("s"), F.sum("val").alias("v"),
        F.min("fit_score").alias("fit"), F.min("confidence").alias("sure"), F.bool_and(F.col("window_match") == "exact").alias("exact"),
    ).where("n = 4 and sound and a = z and s is not null").join(annual.select(*SERIES, "fiscal_year"), [*SERIES, "fiscal_year"], "left_anti")
    own = {
        "start": F.col("s"), "val": F.col("v"), "fit_score": F.col("fit"), "confidence": F.col("sure"), "window_match": F.when(F.col("exact"), "exact").otherwise("near"), "kind": F.lit("annual"),
        "fiscal_quarter": F.lit(None).cast("int"), "expected_start": F.col("s"), "expected_end": F.col("q.end"), "basis": F.lit("annual_window"), "source_kind": F.lit("annual_derived"),
    }
    return one.select(*[own[c].alias(c) if c in own else F.col(c) if c in (*SERIES, "fiscal_year") else F.col(f"q.{c}") for c in quarters.columns])


def build_flow(rows: DataFrame, years: DataFrame, quarters: DataFrame, positive: DataFrame | None = None) -> DataFrame:
    """The best row per metric and fiscal year and per metric and fiscal quarter of resolved flow ``rows`` (see :func:`candidates`).

    Quarters stated, rebuilt by difference, merged from segments and merged from unresolved
    spans compete. ``rows`` are read once for each of these, so they should be a written table. Rebuilt rows with negative revenue are left out, as are negative capex_cash
    of tags in ``positive`` (cik, metric_key, tag, unit) and quarters out of a year where one of
    the tag is stated. All rebuilt spans are resolved in one pass.
    """
    names = [*ROW, "source_kind", "chain", "place"]
    none = lambda df: df.select(*ROW, "source_kind", F.lit(None).cast("long").alias("chain"), F.lit(None).cast("int").alias("place"))
    made = none(from_earlier(rows)).unionByName(none(from_later(rows))).unionByName(none(from_segments(rows))).unionByName(prefixes(rows).select(*names))
    # written, or each condition below would be made anew of all that a period is found by
    told = materialize(periods.resolve_periods(materialize(made, "rebuilt"), years, quarters), "rebuilt-periods").where("kind = 'quarter'")
    derived = F.col("source_kind").isin("cumulative_derived", "annual_derived")
    told = told.where(~derived | (F.col("val") >= 0) | (F.col("metric_key") != "revenue"))
    told = told.where((F.col("source_kind") != "segment_merged") | F.col("window_match").isin("exact", "near"))
    if positive is not None:
        sure = positive.select(*STATED).distinct().withColumn("sure", F.lit(True))
        told = told.join(sure, STATED, "left").where(~(derived & F.col("sure").isNotNull() & (F.col("metric_key") == "capex_cash") & (F.col("val") < 0))).drop("sure")
    merged = Window.partitionBy(*SERIES, "unit", "chain").orderBy("place")
    told = told.withColumn("rn", F.when(F.col("source_kind") == "other_merged", F.row_number().over(merged)).otherwise(1)).where("rn = 1").drop("rn", "chain", "place")
    stated = rows.where("kind = 'quarter' and source_kind = 'raw_direct'").select(*STATED, "fiscal_year", "fiscal_quarter").distinct().withColumn("stated", F.lit(True))
    told = told.join(stated, [*STATED, "fiscal_year", "fiscal_quarter"], "left").where((F.col("source_kind") != "annual_derived") | F.col("stated").isNull()).drop("stated")
    best_quarters = best_rows(rows.where("kind = 'quarter'").unionByName(told.select(*rows.columns)).where("fiscal_year is not null and fiscal_quarter is not null"), [*SERIES, "fiscal_year", "fiscal_quarter"])
    best_quarters = materialize(best_quarters, "best-quarters")
    best_annual = best_rows(rows.where("kind = 'annual' and fiscal_year is not null"), [*SERIES, "fiscal_year"])
    return best_annual.unionByName(summed_years(best_quarters, best_annual)).unionByName(best_quarters)


def build_instant(rows: DataFrame) -> DataFrame:
    """The best snapshot per metric, unit and end of resolved ``rows``."""
    return best_rows(rows.where("end is not null"), [*SERIES, "unit", "end"])


def resolved(facts: DataFrame, years: DataFrame, quarters: DataFrame) -> DataFrame:
    """Mapped facts (``ROW``) as a written table of candidates for :func:`build_resolved`; an instant has no start.

    A fact's period depends on no other fact, so any part of the table can be built from.
    """
    flow = F.col("fact_type").isin(*FLOW_KINDS)
    some = facts.where(flow | (F.col("fact_type") == "instant")).withColumn("start", F.when(flow, F.col("start")))
    return materialize(candidates(some, years, quarters), "candidates")


def build(facts: DataFrame, years: DataFrame, quarters: DataFrame, positive: DataFrame | None = None) -> DataFrame:
    """The metric series of all companies from mapped facts (``ROW``); flows, values per share and share counts as flows, instants as snapshots.

    ``years`` and ``quarters`` are windows as of :func:`fiscal.calendar`. A row is known from
    its filing date on (``effective_date``), or from its end where that is missing.
    """
    return build_resolved(resolved(facts, years, quarters), years, quarters, positive)


def build_resolved(rows: DataFrame, years: DataFrame, quarters: DataFrame, positive: DataFrame | None = None) -> DataFrame:
    """:func:`build` from facts whose periods :func:`resolved` found."""
    every = build_flow(rows.where(F.col("fact_type").isin(*FLOW_KINDS)), years, quarters, positive).unionByName(build_instant(rows.where("fact_type = 'instant'")))
    return every.select(
        *SERIES, F.col("tag").alias("source_tag"), "fact_type", "unit", "val", "start", "end", duration_days(F.col("start"), F.col("end")).alias("duration_days"), "filed",
        F.coalesce("filed", "end").alias("effective_date"), "accn", *LABELS, "fiscal_year", "fiscal_quarter", F.col("kind").alias("period_type"), "source_kind",
    )


#: What tells one row of a series from another.
PERIOD = ["cik", "metric_key", "unit", "period_type", "fiscal_year", "fiscal_quarter", "end"]


def compare(base: DataFrame, wider: DataFrame) -> DataFrame:
    """What a wider set of tags changes, per company and metric: rows of both series, those gained, lost and changed, and the tags that rows come from.

    A row is that of a metric's unit and period; years and quarters are told by their number, snapshots by their end. Values
    that differ by more than a billionth of the larger one are changed. One full join on the period; nulls in it are equal.
    """
    fiscal = F.col("period_type").isin("annual", "quarter") & F.col("fiscal_year").isNotNull()
    key = [*PERIOD[:-1], F.when(~fiscal, F.col("end")).alias("at")]
    one = lambda df, name: df.select(*key, F.struct("val", "source_tag").alias(name))
    both = one(base, "b").withColumn("w", F.lit(None).cast("struct<val:double,source_tag:string>")).unionByName(one(wider, "w").withColumn("b", F.lit(None).cast("struct<val:double,source_tag:string>")))
    rows = both.groupBy(*PERIOD[:-1], "at").agg(F.max("b").alias("b"), F.max("w").alias("w"))
    moved = F.abs(F.col("b.val") - F.col("w.val")) > F.greatest(F.abs("b.val"), F.abs("w.val")) * 1e-9
    count = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    has_b, has_w = F.col("b").isNotNull(), F.col("w").isNotNull()
    return rows.groupBy("cik", "metric_key").agg(
        count(has_b, "base_rows"), count(has_w, "wider_rows"), count(has_w & ~has_b, "gained"), count(has_b & ~has_w, "lost"), count(has_b & has_w & moved, "changed"),
        F.array_sort(F.collect_set("w.source_tag")).alias("tags"),
    )
