"""Reporting periods: expected windows, how well a fact fits them, and quarters rebuilt from cumulative facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.filings import duration_class, fiscal_year, form_hint, frame_parts, period_hint, period_quarter
from tidemark.session import FEATURES_A_TASK, dealt

#: Weights of a window's score, tolerances in days, and the least scores.
START_WEIGHT, END_WEIGHT, LENGTH_WEIGHT = 0.35, 0.45, 0.20
YEAR_TOLERANCE, QUARTER_TOLERANCE, YTD_TOLERANCE = (14, 21), (10, 14), (10, 21)
LEAST_ANNUAL, LEAST_YTD = 0.5, 0.4
QUARTER_LENGTH = (75, 120)


def closeness(days: Column, tolerance: int) -> Column:
    """1 for no distance, a half at the tolerance, 0 beyond it or where it is unknown."""
    return F.when(days <= tolerance, 1 - days / (2 * tolerance)).otherwise(0.0)


def window_score(start: Column, end: Column, low: Column, high: Column, tolerance: tuple[int, int]) -> Column:
    """struct(score, match): exact, near (both ends and the length within tolerance), partial (inside the window) or outside."""
    a, b = F.abs(F.date_diff(start, low)), F.abs(F.date_diff(end, high))
    length = F.abs(F.date_diff(end, start) - F.date_diff(high, low))
    score = START_WEIGHT * closeness(a, tolerance[0]) + END_WEIGHT * closeness(b, tolerance[0]) + LENGTH_WEIGHT * closeness(length, tolerance[1])
    match = F.when((a == 0) & (b == 0), "exact").when((a <= tolerance[0]) & (b <= tolerance[0]) & (length <= tolerance[0]), "near").when((start >= low) & (end <= high), "partial").otherwise("outside")
    return F.struct(score.alias("score"), match.alias("match"))


def year_windows(annual: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(cik, fiscal_year, low, high, exact) for every year: the known annual period, else the latest one moved by whole years.

    ``annual`` has one row per company and fiscal year (cik, fiscal_year, start, end).
    """
    anchor = annual.groupBy("cik").agg(F.max_by(F.struct("fiscal_year", "start", "end"), "fiscal_year").alias("a"))
    every = anchor.withColumn("fiscal_year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    shift = (F.col("fiscal_year") - F.col("a.fiscal_year")) * 12
    known = annual.select("cik", "fiscal_year", F.col("start").alias("s"), F.col("end").alias("e"))
    high = F.date_add(F.add_months(F.date_add("a.end", 1), shift), -1)
    return every.join(known, ["cik", "fiscal_year"], "left").select(
        "cik", "fiscal_year", F.coalesce("s", F.add_months("a.start", shift)).alias("low"), F.coalesce("e", high).alias("high"), F.col("s").isNotNull().alias("exact")
    )


def quarter_windows(years: DataFrame, lengths: tuple[int, int, int] = (91, 91, 91)) -> DataFrame:
    """Each year cut into quarters of the usual lengths in days, the fourth up to the year's end."""
    starts, at = [], 0
    for n in (*lengths, None):
        starts.append(at)
        at += n or 0
    quarters = F.array(*[F.struct(
        F.lit(i + 1).alias("fiscal_quarter"), F.date_add("low", starts[i]).alias("low"),
        (F.date_add("low", starts[i + 1] - 1) if i < 3 else F.col("high")).alias("high"),
    ) for i in range(4)])
    return years.select("cik", "fiscal_year", F.explode(quarters).alias("w")).select("cik", "fiscal_year", "w.*")


def resolve_quarters(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Facts of a quarter's length with the best window of their company: highest score, then the earlier window.

    ``facts`` has cik, start and end. Windows are met by the month of their end and the
    months around it, so a fact is compared with two or three windows of its company.
    Adds fiscal_year, fiscal_quarter, score and match; only exact and near matches stay.
    """
    month = lambda d: F.year(d) * 12 + F.month(d)
    # facts that state one span share its window, so spans are matched once and facts looked up
    some = facts.where(F.date_diff("end", "start").between(QUARTER_LENGTH[0] - 1, QUARTER_LENGTH[1] - 1))
    spans = some.select("cik", "start", "end").distinct().withColumn("m", month(F.col("end")))
    w = windows.select("cik", F.col("fiscal_year").alias("wy"), F.col("fiscal_quarter").alias("wq"), "low", "high").withColumn("m", F.explode(F.array(*[month(F.col("high")) + k for k in (-1, 0, 1)])))
    scored = spans.join(w, ["cik", "m"]).withColumn("s", window_score(F.col("start"), F.col("end"), F.col("low"), F.col("high"), QUARTER_TOLERANCE))
    good = scored.where(F.col("s.match").isin("exact", "near"))
    best = good.groupBy("cik", "start", "end").agg(F.max_by(F.struct("wy", "wq", "s"), F.struct("s.score", -F.col("wy"), -F.col("wq"))).alias("__b"))
    names = [c for c in facts.columns if c not in ("fiscal_year", "fiscal_quarter", "score", "match")]
    told = some.join(best, ["cik", "start", "end"])
    return told.select(*names, F.col("__b.wy").alias("fiscal_year"), F.col("__b.wq").alias("fiscal_quarter"), F.col("__b.s.score").alias("score"), F.col("__b.s.match").alias("match"))


#: What a filing's labels add to a quarter window's score, the least score and the longest partial quarter in days.
QUARTER_BONUS, FRAME_BONUS, QUARTER_PENALTY, LEAST_QUARTER, PARTIAL_DAYS = 0.12, 0.05, 0.20, 0.45, 170
#: How far from a window's end a snapshot may lie, and what labels add to its confidence.
SNAPSHOT_DAYS, SNAPSHOT_BONUS, SNAPSHOT_PENALTY = 14, 0.08, 0.12
#: What speaks for a fact being a quarter's, and how sure its labels alone can make.
QUARTER_SIGNS, LABELS_ALONE = (0.35, 0.25, 0.25, 0.15), 0.7
PERIOD = ["start", "end", "fy", "fp", "form", "frame"]


def resolve_periods(facts: DataFrame, years: DataFrame, quarters: DataFrame) -> DataFrame:
    """Facts (cik, start, end, fy, fp, form, frame, ...) with the fiscal period they report.

    Adds kind (annual, quarter, ytd, instant, other), fiscal_year, fiscal_quarter,
    expected_start, expected_end, fit_score, confidence, window_match and basis. Tried in this
    order: a year's window (``years``), a quarter's (``quarters``) or, if its labels say so,
    the labelled quarter, the span from a year's start to a quarter's end, and for a snapshot
    the quarter end nearest to it. Filing labels raise or lower a quarter's score; of equal
    scores the earlier window wins.

    Facts that state one span under the same labels share their period, so distinct spans
    are matched, with the windows of three years each, and facts look theirs up: the work
    grows with filings and not with their facts, and no fact meets all windows of a company.
    All of a company's is in one task, where a span's choice is the largest of whole numbers
    (:func:`_packed`), so candidates are neither sorted nor shuffled.
    """
    # a company's spans are numbered, so that facts find theirs by two numbers
    keyed = dealt(facts, FEATURES_A_TASK, "cik").withColumn("__n", F.dense_rank().over(Window.partitionBy("cik").orderBy(*PERIOD)))
    span = ["cik", "__n", "k"]
    spans = keyed.select("cik", "__n", F.struct(*PERIOD).alias("k")).distinct()
    own = years.select("cik", F.col("fiscal_year").cast("int").alias("fiscal_year"), F.col("low").alias("year_low"), F.col("high").alias("year_high"))
    cut = own.join(quarters.select("cik", "fiscal_year", "fiscal_quarter", "low", "high"), ["cik", "fiscal_year"])
    whole = own.select("*", F.lit(0).alias("fiscal_quarter"), F.col("year_low").alias("low"), F.col("year_high").alias("high"))
    windows = cut.select(whole.columns).unionByName(whole).where("fiscal_year is not null")
    yearly = windows.groupBy("cik", "fiscal_year").agg(F.sort_array(F.collect_list(F.struct("fiscal_quarter", "low", "high", "year_low"))).alias("x"))
    company = yearly.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("fiscal_year", "x"))).alias("windows"))

    # what can't be known counts as far away or as 0, so that a candidate's columns are plain numbers
    far, known = 100_000, lambda c, other: F.coalesce(c, F.lit(other))
    apart = lambda a, b: known(F.abs(F.date_diff(a, b)), far)
    own_year, frame = fiscal_year(F.col("k.fy")), frame_parts(F.upper(F.trim("k.frame")))
    met = spans.withColumn("f", frame).select(
        *span, "k.start", "k.end", F.date_diff("k.end", "k.start").alias("length"), known(own_year, 0).alias("own_year"), known(period_quarter(F.col("k.fp")), 0).alias("fq"),
        known(F.when(~F.col("f.instant"), F.col("f.quarter")), -1).alias("frame_quarter"), known(F.when(F.col("f.quarter").isNull(), F.col("f.year")), -far).alias("frame_year"),
    )
    about = F.when(F.col("own_year") > 0, F.col("own_year")).otherwise(F.year("end"))
    around = [c + k for c in (about, F.col("frame_year")) for k in (-1, 0, 1)]
    around = F.when(F.col("frame_year") > 0, F.array_distinct(F.array(*around))).otherwise(F.array(*around[:3]))
    met = met.join(company.hint("merge"), "cik", "left").withColumn("fiscal_year", F.explode(around))
    met = met.select(*span, "start", "end", "length", "own_year", "fq", "frame_quarter", "frame_year", "fiscal_year", F.posexplode_outer(F.col("windows")[F.col("fiscal_year")]).alias("place", "w"))
    # a missing fy leaves the years around the end, a given one only those around it; a frame's year counts for annual facts
    here = known((F.col("own_year") == 0) | (F.abs(F.col("fiscal_year") - F.col("own_year")) <= 1), False)
    met = met.select(
        *span, "own_year", "fq", "frame_quarter", known(F.col("fiscal_year"), 0).alias("year"), known(F.col("place"), 0).alias("place"), known(F.col("w.fiscal_quarter"), -1).alias("q"),
        here.alias("here"), (here | known(F.abs(F.col("fiscal_year") - F.col("frame_year")) <= 1, False)).alias("annual_here"), apart("start", "w.low").alias("a"), apart("end", "w.high").alias("b"),
        apart("start", "w.year_low").alias("y"), known(F.abs(F.col("length") - F.date_diff("w.high", "w.low")), far).alias("l"), known(F.abs(F.col("length") - F.date_diff("w.high", "w.year_low")), far).alias("yl"),
    )
    of_year, of_quarter = (F.col("q") == 0) & F.col("annual_here"), (F.col("q") > 0) & F.col("here")
    points = lambda start, length, tolerance: START_WEIGHT * closeness(F.col(start), tolerance[0]) + END_WEIGHT * closeness(F.col("b"), tolerance[0]) + LENGTH_WEIGHT * closeness(F.col(length), tolerance[1])
    labelled = points("a", "l", QUARTER_TOLERANCE) + F.when(F.col("fq") == F.col("q"), QUARTER_BONUS).when(F.col("fq") > 0, -QUARTER_PENALTY).otherwise(0.0) + F.when(F.col("frame_quarter") == F.col("q"), FRAME_BONUS).otherwise(0.0)
    agree = lambda c, w: F.when(F.col(c) == F.col(w), SNAPSHOT_BONUS).otherwise(0.0)
    clash = F.when(((F.col("own_year") > 0) & (F.col("own_year") != F.col("year"))) | ((F.col("fq") > 0) & (F.col("fq") != F.col("q"))), SNAPSHOT_PENALTY).otherwise(0.0)
    snap_sure = _snap(F.col("b")) + agree("own_year", "year") + agree("fq", "q") - clash
    bests = met.groupBy(*span).agg(
        F.max(F.when(of_year, _packed(points("a", "l", YEAR_TOLERANCE)))).alias("at_a"), F.max(F.when(of_quarter, _packed(labelled))).alias("at_b"), F.max(F.when(of_quarter, _packed(points("y", "yl", YTD_TOLERANCE)))).alias("at_c"),
        F.max(F.when(of_quarter, _packed(snap_sure, F.when(F.col("b") <= SNAPSHOT_DAYS, SNAPSHOT_DAYS + 1 - F.col("b")).otherwise(0)))).alias("at_d"),
    ).select("cik", "__n", "k.*", "at_a", "at_b", "at_c", "at_d")

    days = F.when(F.col("start").isNotNull(), F.date_diff("end", "start") + 1)
    told = bests.select(
        "cik", "__n", "start", "end", days.alias("days"), duration_class(days).alias("length"), form_hint(F.col("form")).alias("form"), period_hint(F.col("fp")).alias("hint"), fiscal_year(F.col("fy")).alias("fy"),
        period_quarter(F.col("fp")).alias("fq"), frame_parts(F.upper(F.trim("frame"))).alias("frame"), *[F.col(f"at_{c}") for c in "abcd"],
    )
    signs = (F.col("length") == "quarter", F.col("form") == "quarter", F.col("hint") == "quarter", F.col("frame.quarter").isNotNull() & ~F.col("frame.instant"))
    sure = sum(F.when(F.coalesce(s, F.lit(False)), w).otherwise(0.0) for s, w in zip(signs, QUARTER_SIGNS))
    is_ = lambda kind: (F.col("length") == kind) | (F.col("form") == kind) | (F.col("hint") == kind)
    told = told.select("cik", "__n", "start", "end", "days", "length", "fy", "fq", sure.alias("sure"), is_("annual").alias("is_annual"), is_("quarter").alias("is_quarter"), *[f"at_{c}" for c in "abcd"])
    # by sorting, so that what labels tell and what windows tell aren't one piece of code too long to be compiled; windows that aren't there have null dates: they score 0 and match nothing
    told = told.join(company.hint("merge"), "cik", "left").select(
        *told.columns, *[_window(F.col("windows"), F.col(f"at_{c}")).alias(c) for c in "abcd"], *[_year(F.col(f"at_{c}")).alias(f"year_{c}") for c in "abcd"], _points(F.col("at_b")).alias("points_b"), _points(F.col("at_d")).alias("points_d"),
    )
    fit = lambda c, low, tolerance: window_score(F.col("start"), F.col("end"), F.col(low), F.col(f"{c}.high"), tolerance)
    near = lambda a, b: F.coalesce(F.abs(F.date_diff(a, b)) <= 2, F.lit(False))
    every = told.select(
        "*", fit("a", "a.low", YEAR_TOLERANCE).alias("of_a"), fit("b", "b.low", QUARTER_TOLERANCE)["match"].alias("match_b"), fit("c", "c.year_low", YTD_TOLERANCE).alias("of_c"),
        ((F.col("b.fiscal_quarter") > 1) & near("start", "b.year_low") & near("end", "b.high")).alias("cumulative"), F.abs(F.date_diff("end", "d.high")).alias("off"),
    )
    period = lambda kind, basis, year, quarter, low, high, score, sure, match: F.struct(
        F.lit(kind).alias("kind"), year.cast("int").alias("fiscal_year"), quarter.cast("int").alias("fiscal_quarter"), low.cast("date").alias("expected_start"), high.cast("date").alias("expected_end"),
        score.cast("double").alias("fit_score"), sure.cast("double").alias("confidence"), F.lit(match).alias("window_match") if isinstance(match, str) else match.alias("window_match"), F.lit(basis).alias("basis"),
    )
    none, q = F.lit(None), F.col
    fits = lambda match: match.isin("exact", "near")
    partial = (q("match_b") == "partial") & (q("days") < PARTIAL_DAYS)
    annual = F.when(q("is_annual") & fits(q("of_a.match")) & (q("of_a.score") >= LEAST_ANNUAL), period("annual", "annual_window", q("year_a"), none, q("a.low"), q("a.high"), q("of_a.score"), q("of_a.score"), q("of_a.match")))
    quarter = F.when(q("is_quarter") & ~q("cumulative") & ((fits(q("match_b")) & (q("points_b") >= LEAST_QUARTER)) | partial), period("quarter", "quarter_window", q("year_b"), q("b.fiscal_quarter"), q("b.low"), q("b.high"), q("points_b"), F.least(F.lit(1.0), F.greatest("points_b", "sure")), q("match_b")))
    by_label = F.least(q("sure"), F.lit(LABELS_ALONE))
    labels = F.when(q("is_quarter") & q("fy").isNotNull() & q("fq").isNotNull() & (q("length") == "quarter"), period("quarter", "sec_fp", q("fy"), q("fq"), q("start"), q("end"), by_label, by_label, "exact"))
    ytd = F.when((q("length") == "ytd") & fits(q("of_c.match")) & (q("of_c.score") >= LEAST_YTD), period("ytd", "quarter_window", q("year_c"), q("c.fiscal_quarter"), q("c.year_low"), q("c.high"), q("of_c.score"), q("of_c.score"), q("of_c.match")))
    snapshot = q("length") == "instant"
    both = F.when(q("fy").isNotNull() & q("fq").isNotNull(), 0.65).otherwise(0.45)
    instant = F.when(snapshot & (q("off") <= SNAPSHOT_DAYS), period("instant", "fiscal_profile", q("year_d"), q("d.fiscal_quarter"), q("d.low"), q("d.high"), _snap(q("off")), q("points_d"), F.when(q("off") == 0, "exact").otherwise("near"))).when(
        snapshot, period("instant", "instant_snapshot", q("fy"), q("fq"), none, q("end"), both, both, "unknown"))
    other = period("other", "unresolved", q("fy"), none, none, none, F.lit(0.2), F.lit(0.2), "unknown")
    found = every.select(F.col("cik").alias("__c"), F.col("__n").alias("__m"), F.coalesce(annual, quarter, labels, ytd, instant, other).alias("p"))
    told = keyed.join(found, F.col("cik").eqNullSafe(F.col("__c")) & (F.col("__n") == F.col("__m")))
    return told.select(*[F.col(c) for c in facts.columns if c not in ("kind", "fiscal_year", "fiscal_quarter")], "p.*")


def _snap(off: Column) -> Column:
    """How near a snapshot is to a window's end: 1 for no distance, a half at the farthest, 0 beyond it."""
    return F.when(off <= SNAPSHOT_DAYS, 1 - off / (2 * SNAPSHOT_DAYS)).otherwise(0.0)


def _packed(points: Column, second: Column | None = None) -> Column:
    """A whole number that is larger for more ``points`` (0 to 1, by 9 digits), then for a larger ``second`` (below 16), the earlier year, the earlier window of it."""
    nine = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)) * 1_000_000_000 + 0.5)
    return ((nine * 16 + (F.lit(0) if second is None else second)) * 65_536 + (32_767 - F.col("year"))) * 256 + (255 - F.col("place"))


def _points(packed: Column) -> Column:
    return F.shiftright(packed, 28) / 1e9


def _year(packed: Column) -> Column:
    return (32_767 - F.shiftright(packed, 8).bitwiseAND(65_535)).cast("int")


def _window(windows: Column, packed: Column) -> Column:
    """The window that :func:`_packed` was told of; null where there is none."""
    return F.get(windows[_year(packed)], (255 - packed.bitwiseAND(255)).cast("int"))


def best_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate per period: fit score, tag priority, filing date, source rank, confidence, accession."""
    rank = F.when(F.col("source_kind") == "direct", 0).when(F.col("source_kind") == "cumulative_derived", 1).otherwise(2)
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("priority"), F.desc_nulls_last("filed"), rank.asc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("accn")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _last_stated(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One fact per keys, start and end: of several filings that state it the one filed last, then the larger value."""
    return facts.groupBy(*keys, "start", "end").agg(F.max(F.struct("filed", "val")).alias("__f")).select(*keys, "start", "end", "__f.val", "__f.filed")


def from_differences(facts: DataFrame, keys: tuple[str, ...] = ("cik", "tag", "unit")) -> DataFrame:
    """Quarters as a cumulative fact less the one before it with the same start: start, end, val, source_kind.

    The latest fact that ends strictly earlier is taken, and only differences of a quarter's
    length count. A period that several filings state is first brought to its last statement.
    """
    w = Window.partitionBy(*keys, "start").orderBy("end")
    before = _last_stated(facts, keys).withColumn("__p", F.lag(F.struct("end", "val", "filed")).over(w)).where(F.col("__p").isNotNull())
    start = F.date_add("__p.end", 1)
    length = F.date_diff("end", start) + 1
    return before.where(length.between(*QUARTER_LENGTH)).select(
        *keys, start.alias("start"), "end", (F.col("val") - F.col("__p.val")).alias("val"), F.greatest("filed", "__p.filed").alias("filed"),
        length.alias("duration_days"), F.lit("cumulative_derived").alias("source_kind"),
    )


def from_trailing(facts: DataFrame, keys: tuple[str, ...] = ("cik", "tag", "unit")) -> DataFrame:
    """Leading quarters as a cumulative fact less the longest shorter one with the same end, each by its last statement."""
    w = Window.partitionBy(*keys, "end").orderBy(F.desc("start"))
    after = _last_stated(facts, keys).withColumn("__p", F.lag(F.struct("start", "val", "filed")).over(w)).where(F.col("__p").isNotNull())
    end = F.date_add("__p.start", -1)
    length = F.date_diff(end, "start") + 1
    return after.where(length.between(*QUARTER_LENGTH)).select(
        *keys, "start", end.alias("end"), (F.col("val") - F.col("__p.val")).alias("val"), F.greatest("filed", "__p.filed").alias("filed"),
        length.alias("duration_days"), F.lit("leading_derived").alias("source_kind"),
    )


def chains(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``chain``: rows that follow each other within a day share a number (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.when(F.abs(F.date_diff("start", F.lag("end").over(w)) - 1) <= 1, 0).otherwise(1)
    return rows.withColumn("__f", fresh).withColumn("chain", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def merge_segments(rows: DataFrame, keys: list[str], low: int = QUARTER_LENGTH[0], high: int = QUARTER_LENGTH[1]) -> DataFrame:
    """Chains of two rows or more that together have a quarter's length, summed into one row."""
    merged = chains(rows, keys).groupBy(*keys, "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("val").alias("val"), F.count("*").alias("segments"))
    length = F.date_diff("end", "start") + 1
    return merged.where((F.col("segments") > 1) & length.between(low, high)).drop("chain").withColumn("source_kind", F.lit("segment_merged"))


def annual_from_quarters(rows: DataFrame) -> DataFrame:
    """Years as the sum of four quarters of one tag, where no annual row exists. ``rows`` has both, told apart by period_type."""
    quarters = rows.where("period_type = 'quarter' and fiscal_year is not null and fiscal_quarter is not null")
    summed = quarters.groupBy("cik", "metric_key", "unit", "fiscal_year").agg(
        F.sum("val").alias("val"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("effective_date").alias("effective_date"),
        F.countDistinct("fiscal_quarter").alias("quarters"), F.count("val").alias("n"),
    ).where("quarters = 4 and n = 4")
    known = rows.where("period_type = 'annual'").select("cik", "metric_key", "unit", "fiscal_year")
    return summed.join(known, ["cik", "metric_key", "unit", "fiscal_year"], "left_anti").drop("quarters", "n").withColumn("period_type", F.lit("annual"))


def sum_metric(rows: DataFrame, parts: tuple[str, str], name: str) -> DataFrame:
    """A formula metric: the sum of two metrics at equal ends, known when the later of them is."""
    a = rows.where(F.col("metric_key") == parts[0])
    b = rows.where(F.col("metric_key") == parts[1]).select("cik", "unit", "end", F.col("val").alias("__v"), F.col("filed").alias("__f"))
    told = a.join(b, ["cik", "unit", "end"]).withColumn("val", F.col("val") + F.col("__v")).withColumn("filed", F.greatest("filed", "__f")).withColumn("metric_key", F.lit(name))
    return told.drop("__v", "__f").select(*rows.columns)


def regimes(annual: DataFrame, tolerance: int = 7) -> DataFrame:
    """(cik, regime, first_year, last_year, years): consecutive years whose ends fall within a week of each other's date."""
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    moved = F.abs(F.date_diff("end", F.add_months(F.lag("end").over(w), 12))) > tolerance
    gap = F.col("fiscal_year") - F.lag("fiscal_year").over(w) != 1
    fresh = F.when(F.lag("end").over(w).isNull() | moved | gap, 1).otherwise(0)
    told = annual.withColumn("__f", fresh).withColumn("regime", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy("cik", "regime").agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.count("*").alias("years"))
