"""A company's fiscal calendar as its facts tell it: years, regimes of year ends, quarters, their lengths, and the windows they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import duration_days, fiscal_year_of_end, is_month_end, month_day_distance, weekday
from tidemark.session import discard, materialize

#: Lengths in days of whole years, of the shortest transition period, of quarters, of cumulative spans and of odd spans.
FULL_YEAR, LEAST_TRANSITION, QUARTER, CUMULATIVE, ODD = (330, 400), 30, (60, 140), (120, 320), (45, 180)
#: How many days two dates may lie apart and still be the same, and a quarter's usual length.
CLOSE, USUAL_QUARTER = 7, 91
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
QUARTER_LABELS = ("Q1", "Q2", "Q3", "Q4")


def mode_of(values: Column) -> Column:
    """The commonest value of a short array, of equally common ones the first; null for an empty array."""
    counted = F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(counted)["v"]


def _recent(*columns: str) -> Column:
    """Of several filings the one filed last, then the larger accession; unknown ones come last."""
    return F.max(F.struct("filed", "accn", *columns))


def annual_candidates(facts: DataFrame) -> DataFrame:
    """Spans that annual forms state as a fiscal year: cik, fiscal_year, start, end, days, support, frame, accn, filed, is_transition.

    ``facts``: cik, fy, fp, form, frame, start, end, filed, accn. A span needs a label FY, no
    frame or one of a calendar year, and 30 to 400 days; below 330 it is a transition period.
    ``support`` counts all facts that state the span. Facts without start, end or fy tell nothing.
    """
    days = duration_days(F.col("start"), F.col("end"))
    stated = facts.where(F.col("form").isin(*ANNUAL_FORMS) & F.col("fy").isNotNull() & (days >= LEAST_TRANSITION) & (F.col("frame").isNull() | F.col("frame").rlike(r"^CY\d{4}$")))
    one = stated.groupBy("cik", "start", "end", "fy", F.coalesce("fp", F.lit("")).alias("fp"), "form").agg(F.count("*").alias("n"), _recent("frame").alias("l"))
    told = one.withColumns({"support": F.sum("n").over(Window.partitionBy("cik", "start", "end")), "days": days})
    return told.where((F.upper(F.trim("fp")) == "FY") & (F.col("days") <= FULL_YEAR[1])).select(
        "cik", fiscal_year_of_end(F.col("end")).alias("fiscal_year"), "start", "end", "days", "support", "l.frame", "l.accn", "l.filed", (F.col("days") < FULL_YEAR[0]).alias("is_transition")
    )


def annual_periods(facts: DataFrame) -> DataFrame:
    """One period per company and fiscal year, and which of them is the anchor (the latest whole year, else the latest).

    Whole years win over transitions, then support, no frame, the filing date, length and
    accession; what is still equal goes to the earlier start.
    """
    day = lambda d: F.coalesce(F.unix_date(d), F.lit(0))
    rank = F.struct(
        (~F.col("is_transition")).alias("whole"), "support", F.col("frame").isNull().alias("frameless"), day(F.col("filed")).alias("on"), "days", F.coalesce("accn", F.lit("")).alias("a"), (-F.unix_date("start")).alias("s")
    )
    period = F.struct("start", "end", "days", "accn", "filed", "is_transition")
    best = annual_candidates(facts).groupBy("cik", "fiscal_year").agg(F.max_by(period, rank).alias("p")).select("cik", "fiscal_year", "p.*")
    latest = Window.partitionBy("cik").orderBy("is_transition", F.desc("fiscal_year"))
    return best.withColumn("is_anchor", F.row_number().over(latest) == 1)


def regime_history(annual: DataFrame) -> DataFrame:
    """Runs of years that end within a week of the year before's date: what kind of year they are and how sure that is.

    ``annual`` as of :func:`annual_periods`. Adds regime (from 1), start_year, end_year (null
    for the run that holds the anchor), end_month, end_day, kind (transition,
    calendar_month_end, fiscal_month_end, week_52_53), end_weekday (0 is Sunday), has_53_weeks,
    usual_days, confidence and transition_years. A company's years are few, so a run's years
    are held in one row.
    """
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    moved = F.coalesce(month_day_distance(F.col("end"), F.lag("end").over(w)) > CLOSE, F.lit(True))
    runs = annual.withColumn("m", F.when(moved, 1).otherwise(0)).withColumns({
        "regime": F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)), "anchor_year": F.max(F.when(F.col("is_anchor"), F.col("fiscal_year"))).over(Window.partitionBy("cik")),
    })
    told = runs.groupBy("cik", "regime").agg(
        F.min("fiscal_year").alias("start_year"), F.max("fiscal_year").alias("last_year"), F.first("anchor_year").alias("anchor_year"), F.max_by("end", "fiscal_year").alias("e"), F.count("*").alias("n"),
        F.bool_or("is_transition").alias("broken"), F.bool_and(is_month_end(F.col("end"))).alias("month_ends"), (F.min(weekday(F.col("end"))) == F.max(weekday(F.col("end")))).alias("one_weekday"),
        F.bool_or(F.col("days").isin(364, 365) | (F.col("days") >= 370)).alias("weekly"), F.bool_or(F.col("days") >= 370).alias("long"),
        F.array_sort(F.collect_list(F.struct("fiscal_year", "days"))).alias("lengths"), F.array_sort(F.collect_list(F.when(F.col("is_transition"), F.col("fiscal_year")))).alias("transition_years"),
    )
    year_end = (F.month("e") == 12) & (F.dayofmonth("e") == 31)
    kind = F.when(F.col("broken"), "transition").when(F.col("month_ends") & year_end, "calendar_month_end").when(F.col("month_ends"), "fiscal_month_end").when(F.col("one_weekday") & F.col("weekly"), "week_52_53").otherwise("fiscal_month_end")
    sure = F.when(F.col("n") >= 4, 1.0).when(F.col("n") == 3, 0.9).when(F.col("n") == 2, 0.75).otherwise(0.5)
    return told.withColumn("kind", kind).select(
        "cik", "regime", "start_year", F.when(F.col("last_year") != F.col("anchor_year"), F.col("last_year")).alias("end_year"), F.month("e").alias("end_month"), F.dayofmonth("e").alias("end_day"),
        "kind", weekday(F.col("e")).alias("end_weekday"), ((F.col("kind") == "week_52_53") & F.col("long")).alias("has_53_weeks"),
        mode_of(F.transform("lengths", lambda x: x["days"])).alias("usual_days"), sure.alias("confidence"), "transition_years",
    )


def quarter_candidates(facts: DataFrame) -> DataFrame:
    """Distinct spans labelled Q1 to Q4: cik, fy, fp, start, end, days, n facts, and the last filing of each."""
    stated = facts.where(F.col("fp").isin(*QUARTER_LABELS) & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("fy").isNotNull())
    one = stated.groupBy("cik", "fy", "fp", "start", "end").agg(F.count("*").alias("n"), _recent().alias("l"))
    return one.select("cik", "fy", "fp", "start", "end", duration_days(F.col("start"), F.col("end")).alias("days"), "n", "l.accn", "l.filed")


def quarter_periods(annual: DataFrame, candidates: DataFrame) -> DataFrame:
    """The quarters of every fiscal year, one after the other: cik, fiscal_year, fiscal_quarter, start, end, days, source, accn, filed.

    A quarter is stated directly, or the end of a cumulative span from the year's start closes
    it (first to third), or the year's end does (fourth); the latter two need the quarter
    before, which also bounds a direct one. Of several spans the one filed last wins, then the
    one nearest to 91 days, then the larger accession, the smaller fy and the earlier dates.

    Spans meet the years whose end is in the same or a neighbouring calendar year, so no span
    meets all years of a company; those inside one year are few and are held in one row.
    """
    some = candidates.where(F.col("days").between(QUARTER[0], CUMULATIVE[1])).withColumn("y", F.explode(F.array(*[F.year("end") + k for k in (-1, 0, 1)])))
    years = annual.select("cik", "fiscal_year", F.col("start").alias("low"), F.col("end").alias("high"), F.struct("accn", "filed").alias("by"), F.year("end").alias("y"))
    inside = (F.col("start") >= F.date_add("low", -CLOSE)) & (F.col("end") <= F.date_add("high", CLOSE))
    order = [F.coalesce(F.unix_date("filed"), F.lit(0)).alias("r1"), (-F.abs(F.col("days") - USUAL_QUARTER)).alias("r2"), F.coalesce("accn", F.lit("")).alias("r3"), (-F.col("fy")).alias("r4"), (-F.unix_date("start")).alias("r5"), (-F.unix_date("end")).alias("r6")]
    spans = F.collect_list(F.struct(*order, "fp", "start", "end", "days", "accn", "filed"))
    told = years.join(some.drop("n"), ["cik", "y"]).where(inside).groupBy("cik", "fiscal_year", "low", "high", "by").agg(spans.alias("c"))
    close = lambda a, b: F.abs(F.date_diff(a, b)) <= CLOSE
    low, high, before = F.col("low"), F.col("high"), None
    period = lambda start, end, source, by: F.struct(start.alias("start"), end.alias("end"), duration_days(start, end).alias("days"), F.lit(source).alias("source"), by["accn"].alias("accn"), by["filed"].alias("filed"))
    for q, label in enumerate(QUARTER_LABELS, 1):
        after = lambda c: F.lit(True) if before is None else before.isNull() | (c["start"] > before["end"])  # noqa: E731,B023
        ends = lambda c: close(c["start"], low) if q == 1 else close(c["end"], high) if q == 4 else F.lit(True)  # noqa: E731,B023
        direct = F.array_max(F.filter("c", lambda c: (c["fp"] == label) & c["days"].between(*QUARTER) & ends(c) & after(c)))  # noqa: B023
        told = told.withColumn("d", direct)
        found = F.when(F.col("d").isNotNull(), period(F.col("d.start"), F.col("d.end"), "direct", F.col("d")))
        if q < 4:
            told = told.withColumn("u", F.array_max(F.filter("c", lambda c: (c["fp"] == label) & c["days"].between(*CUMULATIVE) & close(c["start"], low) & ~close(c["end"], high))))  # noqa: B023
            start = low if q == 1 else F.date_add(before["end"], 1)
            found = F.coalesce(found, F.when(F.col("u").isNotNull() & start.isNotNull() & (F.col("u.end") >= start), period(start, F.col("u.end"), "direct" if q == 1 else "cumulative_derived", F.col("u"))))
        else:
            start = F.date_add(before["end"], 1)
            found = F.coalesce(found, F.when(start <= high, period(start, high, "annual_derived", F.col("by"))))
        told = told.withColumn(f"q{q}", found)
        before = F.col(f"q{q}")
    every = F.filter(F.array(*[F.struct(F.lit(q).alias("fiscal_quarter"), F.col(f"q{q}").alias("p")) for q in (1, 2, 3, 4)]), lambda x: x["p"].isNotNull())
    return told.select("cik", "fiscal_year", F.explode(every).alias("x")).select("cik", "fiscal_year", "x.fiscal_quarter", "x.p.*")


def quarter_lengths(quarters: DataFrame) -> DataFrame:
    """Per company and quarter: least, most and usual days, how many, and the usual month and day (MM-dd) of start and end."""
    rows = quarters.groupBy("cik", "fiscal_quarter").agg(
        F.min("days").alias("least_days"), F.max("days").alias("most_days"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("fiscal_year", "days", "start", "end"))).alias("x")
    )
    usual = lambda f: mode_of(F.transform("x", f))
    return rows.select(
        "cik", "fiscal_quarter", "least_days", "most_days", "n", usual(lambda x: x["days"]).alias("usual_days"),
        usual(lambda x: F.date_format(x["start"], "MM-dd")).alias("usual_start"), usual(lambda x: F.date_format(x["end"], "MM-dd")).alias("usual_end"),
    )


def odd_lengths(candidates: DataFrame) -> DataFrame:
    """Per company and label the spans of 45 to 180 days that are neither a quarter's nor cumulative: least, most, facts."""
    odd = F.col("days").between(*ODD) & ~F.col("days").between(*QUARTER) & ~F.col("days").between(*CUMULATIVE)
    return candidates.where(odd).groupBy("cik", "fp").agg(F.min("days").alias("least_days"), F.max("days").alias("most_days"), F.sum("n").alias("n"))


def profiles(annual: DataFrame, regimes: DataFrame) -> DataFrame:
    """One row per company: known years, the anchor, the current regime, the usual length of a year, whether any regime had 53 weeks."""
    years = annual.groupBy("cik").agg(
        F.min("fiscal_year").alias("earliest_year"), F.max("fiscal_year").alias("latest_year"), F.max_by(F.struct("start", "end", "days", "is_transition", "accn", "filed"), "is_anchor").alias("a"),
        F.max_by("days", F.when(~F.col("is_transition"), F.col("fiscal_year"))).alias("whole_days"),
    )
    now = regimes.groupBy("cik").agg(F.max_by(F.struct("kind", "start_year", "end_year", "end_weekday"), "regime").alias("r"), F.bool_or("has_53_weeks").alias("has_53_weeks"))
    return years.join(now, "cik").select(
        "cik", "earliest_year", "latest_year", F.col("a.start").alias("anchor_start"), F.col("a.end").alias("anchor_end"), F.month("a.end").alias("end_month"), F.dayofmonth("a.end").alias("end_day"),
        F.col("r.kind").alias("regime_kind"), F.col("r.start_year").alias("regime_start"), F.col("r.end_year").alias("regime_end"), (F.col("r.kind") == "week_52_53").alias("is_week_based"), F.col("r.end_weekday").alias("end_weekday"),
        "has_53_weeks", F.when(F.col("a.is_transition"), F.col("whole_days")).otherwise(F.col("a.days")).alias("annual_days"), F.col("a.accn").alias("accn"), F.col("a.filed").alias("filed"),
    )


def year_windows(annual: DataFrame, regimes: DataFrame, companies: DataFrame) -> DataFrame:
    """(cik, fiscal_year, low, high, exact) for each year from a company's first to its last known one.

    A known year is its own window. A missing one ends on its regime's month and day (the
    anchor's where no regime covers the year) and has the regime's usual length.
    """
    every = companies.select("*", F.explode(F.sequence("earliest_year", "latest_year")).alias("fiscal_year"))
    known = annual.select("cik", "fiscal_year", F.col("start").alias("s"), F.col("end").alias("e"))
    covers = (F.col("fiscal_year") >= F.col("start_year")) & (F.col("end_year").isNull() | (F.col("fiscal_year") <= F.col("end_year")))
    first = regimes.select("cik", "regime", "start_year", "end_year", F.struct("end_month", "end_day", "usual_days").alias("r"))
    met = every.select("cik", "fiscal_year").join(first, "cik").where(covers).groupBy("cik", "fiscal_year").agg(F.min_by("r", "regime").alias("r"))
    told = every.join(met, ["cik", "fiscal_year"], "left").join(known, ["cik", "fiscal_year"], "left")
    month, day = F.coalesce("r.end_month", "end_month"), F.coalesce("r.end_day", "end_day")
    year = F.col("fiscal_year") + F.when((month == 1) & (day <= 7), 1).otherwise(0)
    high = F.date_add(F.make_date(year, month, F.lit(1)), day - 1)
    low = F.date_add(high, 1 - F.coalesce("r.usual_days", "annual_days", F.lit(365)))
    return told.select("cik", "fiscal_year", F.coalesce("s", low).alias("low"), F.coalesce("e", high).alias("high"), F.col("s").isNotNull().alias("exact"))


def quarter_windows(years: DataFrame, quarters: DataFrame, lengths: DataFrame) -> DataFrame:
    """(cik, fiscal_year, fiscal_quarter, low, high): the known quarters of a year if all four are, else the year cut by usual lengths."""
    known = quarters.groupBy("cik", "fiscal_year").agg(F.array_sort(F.collect_list(F.struct("fiscal_quarter", F.col("start").alias("low"), F.col("end").alias("high")))).alias("k")).where(F.size("k") == 4)
    usual = lengths.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("fiscal_quarter", "usual_days"))).alias("u"))
    told = years.join(known, ["cik", "fiscal_year"], "left").join(usual, "cik", "left")
    days = [F.coalesce(F.col("u")[F.lit(q)], F.round(duration_days(F.col("low"), F.col("high")) / 4).cast("int")) for q in (1, 2, 3)]
    at = [F.col("low"), F.date_add("low", days[0]), F.date_add("low", days[0] + days[1]), F.date_add("low", days[0] + days[1] + days[2])]
    cut = F.array(*[F.struct(F.lit(q + 1).alias("fiscal_quarter"), at[q].alias("low"), (F.date_add(at[q + 1], -1) if q < 3 else F.col("high")).alias("high")) for q in range(4)])
    return told.select("cik", "fiscal_year", F.explode(F.coalesce("k", cut)).alias("w")).select("cik", "fiscal_year", "w.*")


def calendar(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Year and quarter windows of all companies, straight from their facts, as period resolution takes them.

    Annual periods, quarters and both windows are written to the shared folder, as each is
    used several times; they have a few rows for each company and year.
    """
    annual = materialize(annual_periods(facts), "annual")
    quarters = materialize(quarter_periods(annual, quarter_candidates(facts)), "quarters")
    regimes = regime_history(annual)
    years = materialize(year_windows(annual, regimes, profiles(annual, regimes)), "years")
    cut = materialize(quarter_windows(years, quarters, quarter_lengths(quarters)), "windows")
    discard(annual)
    discard(quarters)
    return years, cut
