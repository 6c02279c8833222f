"""Fiscal calendars, metric series from facts, and feature vectors: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features, fiscal, fiscal_store, metric_series, periods
from tidemark.plans import sql
from tidemark.plans.common import rounded, stored
from tidemark.session import SERIES_A_TASK, dealt, materialize, scratch_path
from tidemark.sources import adapters, facts


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filed facts of :func:`_filed` as a table: calendars, series and rebuilt rows read them several times."""
    return stored(spark, sf_dir, "filings", lambda: _filed(spark, sf_dir))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's quarter as filed facts: the quarter, the span from the year's start, a snapshot, two halves with labels and two without, and restated years.

    Dates are some days off the calendar; every third supplier moves its year by 20 days in
    1997, every fourth quarter isn't labelled, some years are labelled as the next.
    """
    # a quarter makes up to eight facts, which stay in its task; counted and read from a table, as line items are many
    q = dealt(materialize(adapters.quarters(spark, sf_dir), "quarters"), SERIES_A_TASK // 8, "s")
    year, k = F.year("start"), F.col("qn") % 4 + 1
    off = (F.col("s") % 5 - F.when((F.col("s") % 3 == 0) & (year >= 1997), 20).otherwise(0)).cast("int")
    upto = F.round(F.sum("r").over(Window.partitionBy("s", year).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)), 4)
    q = q.select("*", year.alias("y"), k.alias("k"), upto.alias("ytd"), F.date_add("start", off).alias("b"), F.date_add("end", off).alias("e"), F.date_add(F.trunc("start", "year"), off).alias("yb"))
    label, form = F.concat(F.lit("Q"), F.col("k")), F.when(F.col("k") == 4, "10-K").otherwise("10-Q")
    none = F.lit(None).cast("string")
    stated = F.when((F.col("s") + F.col("qn")) % 4 != 0, label)

    def fact(tag, metric, kind, start, end, val, fp, form_, later=0):
        return F.struct(F.lit(tag).alias("tag"), F.lit(metric).alias("metric_key"), F.lit(kind).alias("fact_type"), start.alias("start"), end.alias("end"), val.cast("double").alias("val"), fp.alias("fp"), form_.alias("form"), F.lit(later).alias("later"))

    r, n, b, e, last = F.col("r"), F.col("n"), F.col("b"), F.col("e"), F.col("k") == 4
    kinds = F.array(
        fact("Revenues", "revenue", "flow", b, e, r, stated, form),
        fact("Revenues", "revenue", "flow", F.col("yb"), e, F.col("ytd"), F.when(last, "FY").otherwise(label), form),
        F.when(last, fact("Revenues", "revenue", "flow", F.col("yb"), e, F.col("ytd") + 100, F.lit("FY"), form, 365)),
        fact("Quantity", "assets", "instant", F.lit(None).cast("date"), e, F.col("cn"), label, form),
        fact("Segments", "net_income", "flow", b, F.date_add("b", 44), n, label, form), fact("Segments", "net_income", "flow", F.date_add("b", 45), e, n * 2, label, form),
        fact("Parts", "capex_cash", "flow", F.date_add("b", (k % 2 * 3).cast("int")), F.date_add("b", 44), n * 3, none, F.lit("8-K")), fact("Parts", "capex_cash", "flow", F.date_add("b", 45), e, n * 4, none, F.lit("8-K")),
    )
    told = q.withColumn("f", F.explode(kinds)).where("f is not null")
    return told.select(
        F.col("s").alias("cik"), "f.tag", "f.metric_key", "f.fact_type", F.lit("USD").alias("unit"), F.lit(1).alias("priority"), "f.start", "f.end", "f.val", F.date_add("e", F.col("f.later") + 30).alias("filed"),
        F.concat_ws("-", "s", "qn", "f.later").alias("accn"), (F.col("y") + F.when((F.col("s") + F.col("y")) % 7 == 0, 1).otherwise(0)).cast("int").alias("fy"), "f.fp", "f.form", none.alias("frame"),
    )


def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual period of each supplier's fiscal year and the anchor among them."""
    return fiscal.annual_periods(_filings(spark, sf_dir))


def fiscal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of like year ends, what kind of year they are and how sure."""
    told = fiscal.regime_history(fiscal.annual_periods(_filings(spark, sf_dir)))
    return told.withColumn("transition_years", F.size("transition_years"))


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filings(spark, sf_dir)
    return fiscal.quarter_periods(fiscal.annual_periods(rows), fiscal.quarter_candidates(rows))


def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters of each fiscal year: stated, closed by a cumulative span, or by the year's end."""
    return _quarters(spark, sf_dir)


def quarter_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.quarter_lengths(_quarters(spark, sf_dir))


def odd_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.odd_lengths(fiscal.quarter_candidates(_filings(spark, sf_dir)))


def fiscal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = fiscal.annual_periods(_filings(spark, sf_dir))
    return fiscal.profiles(annual, fiscal.regime_history(annual))


def fiscal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and quarter windows of all suppliers, the year as quarter 0."""
    years, quarters = fiscal.calendar(_filings(spark, sf_dir))
    return years.select("cik", "fiscal_year", F.lit(0).alias("fiscal_quarter"), "low", "high").unionByName(quarters)


def _profile_store(spark: SparkSession, sf_dir: str) -> fiscal_store.ProfileStore:
    """Profiles stored from what was filed before 1996, then updated from all filings."""
    rows = _filings(spark, sf_dir)
    store = fiscal_store.ProfileStore(spark, scratch_path(spark, "profiles"))
    store.update(fiscal_store.profile(rows.where("filed < date'1996-01-01'")))
    store.update(fiscal_store.profile(rows))
    return store


def stored_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all suppliers, read from the store of their profiles."""
    years, quarters = _profile_store(spark, sf_dir).calendar()
    told = years.select("cik", "fiscal_year", F.lit(0).alias("fiscal_quarter"), "low", "high").unionByName(quarters)
    return told.withColumn("cik", F.col("cik").cast("long"))


def stored_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of like year ends, read back from the JSON text that the store keeps of them."""
    told, _ = fiscal_store.regimes(_profile_store(spark, sf_dir).rows())
    return told.withColumns({"cik": F.col("cik").cast("long"), "transition_years": F.size("transition_years")})


def built_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric series of all suppliers from their facts: every way to a quarter, the best row per period, summed years."""
    rows = _filings(spark, sf_dir)
    return rounded(metric_series.build(rows, *fiscal.calendar(rows)), 4)


def experiment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the series of all suppliers gain from a wider set of tags, some of which are open to some sectors only."""
    wide = {"Revenues": [], "Quantity": [], "Segments": ["EUROPE", "ASIA", "AMERICA"], "Parts": ["EUROPE", "AFRICA"]}
    registry = spark.createDataFrame([(t, True, s, []) for t, s in wide.items()], "tag string, enabled boolean, include_sectors array<string>, exclude_sectors array<string>")
    rows = _filings(spark, sf_dir)
    companies = adapters.companies(spark, sf_dir).select(F.col("cik").cast("long").alias("cik"), "sector")
    calendar = fiscal.calendar(rows)
    # both sets of tags are parts of the facts, whose periods are found once
    found = metric_series.resolved(rows, *calendar)
    opened = facts.gate_by_sector(found.join(F.broadcast(registry), "tag"), companies)
    base = metric_series.build_resolved(found.where("tag in ('Revenues', 'Quantity')"), *calendar)
    told = metric_series.compare(base, metric_series.build_resolved(opened, *calendar))
    return told.withColumn("tags", F.concat_ws(",", "tags"))


def rebuilt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that the series builder makes of stated ones, by source: differences, leading spans, segments, and prefixes of chains.

    Kinds go by tag and length here, so that each source can be told without the resolver before it.
    """
    days, quarter = F.date_diff("end", "start") + 1, F.regexp_extract("fp", "Q([1-4])", 1).try_cast("int")
    kind = F.when(F.col("tag") == "Segments", "quarter").when(F.col("tag") == "Parts", "other").when(days >= 330, "annual").when(days >= 120, "ytd").otherwise("quarter")
    filing = Window.partitionBy("cik", "metric_key", "accn")
    rows = _filings(spark, sf_dir).where("fact_type = 'flow'").select(
        "*", kind.alias("kind"), F.when(F.col("tag") == "Segments", "raw_partial").otherwise("raw_direct").alias("source_kind"), F.col("fy").alias("fiscal_year"), quarter.alias("fiscal_quarter"),
        F.min("start").over(filing).alias("expected_start"), F.max("end").over(filing).alias("expected_end"),
    )
    made = [metric_series.from_earlier(rows), metric_series.from_later(rows), metric_series.from_segments(rows), metric_series.prefixes(rows)]
    names = ["cik", "metric_key", "tag", "start", "end", "val", "filed", "accn", "source_kind"]
    told = [df.select(*names, F.lit(way).alias("way"), (F.col("place") if way == "prefix" else F.lit(0)).alias("place")) for df, way in zip(made, ("earlier", "later", "segment", "prefix"))]
    return rounded(told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]), 4)


def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust scores of each supplier's last snapshots as one vector."""
    rows = adapters.instant_series(spark, sf_dir)
    last = rows.groupBy("ticker", "metric_key").agg(F.max_by("val", "end").alias("feature_value"))
    told = features.vector_matrix(last.withColumns({"factor": F.lit("f"), "axis": F.lit("a"), "feature_key": F.lit("level")}))
    return told.select("ticker", F.concat_ws(",", "feature_keys").alias("feature_keys"), F.posexplode("values").alias("pos", "z"), "observed", "missing", "coverage").withColumn("z", F.round("z", 6))


QUERIES = {f.__name__: f for f in (fiscal_years, fiscal_history, fiscal_quarters, quarter_durations, odd_durations, fiscal_profiles, fiscal_windows, stored_calendars, stored_regimes, experiment_series, built_series, rebuilt_rows, vector_matrix)}

_FACTS = f"""{sql.QUARTERS},
g AS (SELECT *, year(start) AS y, qn % 4 + 1 AS k, CAST(s % 5 - CASE WHEN s % 3 = 0 AND year(start) >= 1997 THEN 20 ELSE 0 END AS INT) AS o FROM quarters),
h AS (SELECT *, start + o AS b, "end" + o AS e, make_date(y, 1, 1) + o AS yb, 'Q' || k AS label FROM g),
raw AS (
  SELECT s, y, qn, 0 AS later, e AS f, b AS start, e AS "end", CASE WHEN (s + qn) % 4 <> 0 THEN label END AS fp, k = 4 AS last FROM h
  UNION ALL SELECT s, y, qn, 0, e, yb, e, CASE WHEN k = 4 THEN 'FY' ELSE label END, k = 4 FROM h UNION ALL SELECT s, y, qn, 365, e, yb, e, 'FY', true FROM h WHERE k = 4
  UNION ALL SELECT s, y, qn, 0, e, b, b + 44, label, k = 4 FROM h UNION ALL SELECT s, y, qn, 0, e, b + 45, e, label, k = 4 FROM h),
facts AS (SELECT s AS cik, start, "end", CAST("end" - start + 1 AS INT) AS days, fp, last, f + 30 + later AS filed, s || '-' || qn || '-' || later AS accn, CAST(y + CASE WHEN (s + y) % 7 = 0 THEN 1 ELSE 0 END AS INT) AS fy FROM raw)"""
_YEARS = f"""{_FACTS},
a0 AS (SELECT cik, fy, start, "end", days, arg_max(accn, (filed, accn)) AS accn, max(filed) AS filed, count(*) AS n FROM facts WHERE last AND fp = 'FY' AND days BETWEEN 30 AND 400 GROUP BY ALL),
a1 AS (SELECT *, (SELECT count(*) FROM facts f WHERE f.cik = a0.cik AND f.start = a0.start AND f."end" = a0."end" AND f.last AND f.days >= 30) AS support, CAST(CASE WHEN month("end") = 1 AND day("end") <= 7 THEN year("end") - 1 ELSE year("end") END AS INT) AS fiscal_year FROM a0),
annual0 AS (SELECT cik, fiscal_year, start, "end", days, accn, filed, days < 330 AS is_transition FROM a1 QUALIFY row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY days < 330, support DESC, filed DESC, days DESC, accn DESC, start) = 1),
annual AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY is_transition, fiscal_year DESC) = 1 AS is_anchor FROM annual0)"""
_RUNS = f"""{_YEARS},
m0 AS (SELECT *, dayofyear("end") AS d, lag(dayofyear("end")) OVER (PARTITION BY cik ORDER BY fiscal_year) AS p FROM annual),
m1 AS (SELECT *, sum(CASE WHEN p IS NULL OR least(abs(d - p), 366 - abs(d - p)) > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY cik ORDER BY fiscal_year) AS regime FROM m0),
runs AS (SELECT cik, regime, CAST(min(fiscal_year) AS INT) AS start_year, CAST(CASE WHEN NOT bool_or(is_anchor) THEN max(fiscal_year) END AS INT) AS end_year, arg_max("end", fiscal_year) AS e, count(*) AS n, bool_or(is_transition) AS broken, bool_and("end" = last_day("end")) AS ends,
  count(DISTINCT dayofweek("end")) = 1 AS one, bool_or(days IN (364, 365) OR days >= 370) AS weekly, bool_or(days >= 370) AS long, list(days ORDER BY fiscal_year) AS l, count(*) FILTER (is_transition) AS t FROM m1 GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN broken THEN 'transition' WHEN ends AND month(e) = 12 THEN 'calendar_month_end' WHEN ends THEN 'fiscal_month_end' WHEN one AND weekly THEN 'week_52_53' ELSE 'fiscal_month_end' END AS kind FROM runs)"""
_QUARTERS = f"""{_RUNS},
c0 AS (SELECT cik, fy, fp, start, "end", days, count(*) AS n, max(filed) AS filed, arg_max(accn, (filed, accn)) AS accn FROM facts WHERE fp LIKE 'Q%' GROUP BY ALL),
c1 AS (SELECT a.cik, a.fiscal_year, a.start AS low, a."end" AS high, a.accn AS ya, a.filed AS yf, CAST(right(fp, 1) AS INT) AS k, c0.* EXCLUDE (cik) FROM annual a JOIN c0 ON c0.cik = a.cik AND c0.start >= a.start - 7 AND c0."end" <= a."end" + 7),
r1 AS (SELECT cik, fiscal_year, low, high, ya, yf, arg_max({{'b': start, 'e': "end", 'a': accn, 'f': filed}}, (filed, -abs(days - 91), accn, -fy, -epoch(start), -epoch("end"))) FILTER (k = 1 AND days BETWEEN 60 AND 140 AND abs(start - low) <= 7) AS d,
  arg_max({{'b': low, 'e': "end", 'a': accn, 'f': filed}}, (filed, -abs(days - 91), accn, -fy, -epoch(start), -epoch("end"))) FILTER (k = 1 AND days BETWEEN 120 AND 320 AND abs(start - low) <= 7 AND abs("end" - high) > 7) AS u FROM c1 GROUP BY ALL),
s1 AS (SELECT * EXCLUDE (d, u), coalesce(d, u) AS q, CASE WHEN d IS NOT NULL OR u IS NOT NULL THEN 'direct' END AS w FROM r1)"""


def _next(k: int) -> str:
    order = '(c.filed, -abs(c.days - 91), c.accn, -c.fy, -epoch(c.start), -epoch(c."end"))'
    pick = lambda b: f"""arg_max({{'b': {b}, 'e': c."end", 'a': c.accn, 'f': c.filed}}, {order})"""
    bound = "AND abs(c.\"end\" - c.high) <= 7" if k == 4 else ""
    other = "CASE WHEN any_value(p.q.e) + 1 <= any_value(p.high) THEN {'b': any_value(p.q.e) + 1, 'e': any_value(p.high), 'a': any_value(p.ya), 'f': any_value(p.yf)} END" if k == 4 else pick("p.q.e + 1") + ' FILTER (c.k = %d AND c.days BETWEEN 120 AND 320 AND abs(c.start - c.low) <= 7 AND abs(c."end" - c.high) > 7 AND p.q IS NOT NULL AND c."end" > p.q.e)' % k
    return f""",
r{k} AS (SELECT p.cik, p.fiscal_year, any_value(p.low) AS low, any_value(p.high) AS high, any_value(p.ya) AS ya, any_value(p.yf) AS yf, {pick("c.start")} FILTER (c.k = {k} AND c.days BETWEEN 60 AND 140 AND (p.q IS NULL OR c.start > p.q.e) {bound}) AS d, {other} AS u
  FROM s{k - 1} p JOIN c1 c USING (cik, fiscal_year) GROUP BY 1, 2),
s{k} AS (SELECT * EXCLUDE (d, u), coalesce(d, u) AS q, CASE WHEN d IS NOT NULL THEN 'direct' WHEN u IS NOT NULL THEN '{'annual_derived' if k == 4 else 'cumulative_derived'}' END AS w FROM r{k})"""


_QUARTERS += "".join(_next(k) for k in (2, 3, 4)) + ",\nfq AS (" + " UNION ALL ".join(
    f"""SELECT cik, fiscal_year, {k} AS fiscal_quarter, q.b AS start, q.e AS "end", CAST(q.e - q.b + 1 AS INT) AS days, w AS source, q.a AS accn, q.f AS filed FROM s{k} WHERE q IS NOT NULL""" for k in (1, 2, 3, 4)) + ")"
_LENGTHS = f"""{_QUARTERS}, ln AS (SELECT cik, fiscal_quarter, days, strftime(start, '%m-%d') AS sd, strftime("end", '%m-%d') AS ed, fiscal_year FROM fq),
ud AS (SELECT cik, fiscal_quarter, days FROM ln GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cik, fiscal_quarter ORDER BY count(*) DESC, min(fiscal_year)) = 1),
us AS (SELECT cik, fiscal_quarter, sd FROM ln GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cik, fiscal_quarter ORDER BY count(*) DESC, min(fiscal_year)) = 1),
ue AS (SELECT cik, fiscal_quarter, ed FROM ln GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cik, fiscal_quarter ORDER BY count(*) DESC, min(fiscal_year)) = 1)"""
_USUAL = """usual AS (SELECT cik, regime, days FROM m1 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cik, regime ORDER BY count(*) DESC, min(fiscal_year)) = 1)"""

SQL = {
    "fiscal_years": f"WITH {_YEARS} SELECT cik, fiscal_year, start, \"end\", days, accn, filed, is_transition, is_anchor FROM annual",
    "fiscal_history": f"""WITH {_RUNS}, {_USUAL} SELECT cik, CAST(regime AS BIGINT) AS regime, start_year, end_year, CAST(month(e) AS INT) AS end_month, CAST(day(e) AS INT) AS end_day, kind, CAST(dayofweek(e) AS INT) AS end_weekday,
  kind = 'week_52_53' AND long AS has_53_weeks, days AS usual_days, CAST(CASE WHEN n >= 4 THEN 1 WHEN n = 3 THEN 0.9 WHEN n = 2 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence, CAST(t AS INT) AS transition_years FROM kinds JOIN usual USING (cik, regime)""",
    "fiscal_quarters": f"WITH {_QUARTERS} SELECT * FROM fq",
    "quarter_durations": f"""WITH {_LENGTHS} SELECT cik, fiscal_quarter, min(l.days) AS least_days, max(l.days) AS most_days, count(*) AS n, any_value(ud.days) AS usual_days, any_value(us.sd) AS usual_start, any_value(ue.ed) AS usual_end
FROM ln l JOIN ud USING (cik, fiscal_quarter) JOIN us USING (cik, fiscal_quarter) JOIN ue USING (cik, fiscal_quarter) GROUP BY 1, 2""",
    "odd_durations": f"""WITH {_QUARTERS} SELECT cik, fp, min(days) AS least_days, max(days) AS most_days, CAST(sum(n) AS BIGINT) AS n FROM c0 WHERE days BETWEEN 45 AND 59 GROUP BY 1, 2""",
    "fiscal_profiles": f"""WITH {_RUNS}, z AS (SELECT cik, arg_max({{'k': kind, 's': start_year, 'e': end_year, 'w': CAST(dayofweek(e) AS INT)}}, regime) AS r, bool_or(kind = 'week_52_53' AND long) AS has_53_weeks FROM kinds GROUP BY 1),
y AS (SELECT cik, min(fiscal_year) AS earliest_year, max(fiscal_year) AS latest_year, arg_max(days, fiscal_year) FILTER (NOT is_transition) AS whole FROM annual GROUP BY 1)
SELECT cik, earliest_year, latest_year, a.start AS anchor_start, a."end" AS anchor_end, CAST(month(a."end") AS INT) AS end_month, CAST(day(a."end") AS INT) AS end_day, r.k AS regime_kind, r.s AS regime_start, r.e AS regime_end, r.k = 'week_52_53' AS is_week_based, r.w AS end_weekday,
  has_53_weeks, CASE WHEN a.is_transition THEN whole ELSE a.days END AS annual_days, a.accn, a.filed FROM y JOIN z USING (cik) JOIN annual a USING (cik) WHERE a.is_anchor""",
    "fiscal_windows": f"""WITH {_LENGTHS}, {_USUAL}, rg AS (SELECT k.*, u.days AS usual_days FROM kinds k JOIN usual u USING (cik, regime)),
sp AS (SELECT cik, unnest(range(min(fiscal_year), max(fiscal_year) + 1)) AS fiscal_year FROM annual GROUP BY 1),
mi AS (SELECT sp.cik, sp.fiscal_year, coalesce(r.e, an."end") AS e, coalesce(r.usual_days, an.days) AS days FROM sp JOIN annual an ON an.cik = sp.cik AND an.is_anchor LEFT JOIN rg r ON r.cik = sp.cik AND sp.fiscal_year >= r.start_year AND (r.end_year IS NULL OR sp.fiscal_year <= r.end_year)
  QUALIFY row_number() OVER (PARTITION BY sp.cik, sp.fiscal_year ORDER BY r.regime) = 1),
md AS (SELECT *, make_date(fiscal_year + CASE WHEN month(e) = 1 AND day(e) <= 7 THEN 1 ELSE 0 END, month(e), 1) + CAST(day(e) - 1 AS INT) AS hi FROM mi),
yw AS (SELECT md.cik, CAST(md.fiscal_year AS INT) AS fiscal_year, coalesce(a.start, hi + 1 - md.days) AS low, coalesce(a."end", hi) AS high FROM md LEFT JOIN annual a ON a.cik = md.cik AND a.fiscal_year = md.fiscal_year),
kn AS (SELECT cik, fiscal_year FROM fq GROUP BY 1, 2 HAVING count(*) = 4),
dd AS (SELECT yw.*, [coalesce((SELECT ud.days FROM ud WHERE ud.cik = yw.cik AND ud.fiscal_quarter = 1), CAST(round((high - low + 1) / 4) AS INT)), coalesce((SELECT ud.days FROM ud WHERE ud.cik = yw.cik AND ud.fiscal_quarter = 2), CAST(round((high - low + 1) / 4) AS INT)),
  coalesce((SELECT ud.days FROM ud WHERE ud.cik = yw.cik AND ud.fiscal_quarter = 3), CAST(round((high - low + 1) / 4) AS INT))] AS d FROM yw ANTI JOIN kn USING (cik, fiscal_year)),
cw AS (SELECT cik, fiscal_year, k, low + CAST(CASE k WHEN 1 THEN 0 WHEN 2 THEN d[1] WHEN 3 THEN d[1] + d[2] ELSE d[1] + d[2] + d[3] END AS INT) AS lo, CASE k WHEN 4 THEN high ELSE low + CAST(CASE k WHEN 1 THEN d[1] WHEN 2 THEN d[1] + d[2] ELSE d[1] + d[2] + d[3] END - 1 AS INT) END AS hi FROM dd, (VALUES (1), (2), (3), (4)) v(k))
SELECT cik, fiscal_year, 0 AS fiscal_quarter, low, high FROM yw UNION ALL SELECT cik, fiscal_year, k, lo, hi FROM cw UNION ALL SELECT cik, fiscal_year, fiscal_quarter, start, "end" FROM fq JOIN kn USING (cik, fiscal_year)""",
    "vector_matrix": f"""WITH {sql.INSTANT}, l AS (SELECT ticker, 'f.a.' || metric_key || '.level' AS key, arg_max(val, "end") AS x FROM instant GROUP BY 1, 2),
md AS (SELECT *, median(x) OVER (PARTITION BY key) AS c, stddev_pop(x) OVER (PARTITION BY key) AS sd FROM l), mm AS (SELECT *, median(abs(x - c)) OVER (PARTITION BY key) * 1.4826 AS mad FROM md),
ks AS (SELECT string_agg(DISTINCT key, ',' ORDER BY key) AS feature_keys, count(DISTINCT key) AS n FROM l)
SELECT ticker, feature_keys, CAST(row_number() OVER (PARTITION BY ticker ORDER BY key) - 1 AS INT) AS pos, round(greatest(-3, least(3, (x - c) / CASE WHEN mad <> 0 THEN mad WHEN sd <> 0 THEN sd ELSE 1 END)), 6) AS z, CAST(n AS INT) AS observed, 0 AS missing, 1.0::DOUBLE AS coverage FROM mm, ks""",
}

_STATED = f"""{sql.QUARTERS},
g AS (SELECT *, year(start) AS y, qn % 4 + 1 AS k, CAST(s % 5 - CASE WHEN s % 3 = 0 AND year(start) >= 1997 THEN 20 ELSE 0 END AS INT) AS o, round(sum(r) OVER (PARTITION BY s, year(start) ORDER BY start), 4) AS ytd FROM quarters),
h AS (SELECT *, start + o AS b, "end" + o AS e, make_date(y, 1, 1) + o AS yb, 'Q' || k AS label, CASE WHEN k = 4 THEN '10-K' ELSE '10-Q' END AS form FROM g),
fx AS (
  SELECT s, y, qn, e AS f, 0 AS later, 'Revenues' AS tag, 'revenue' AS metric_key, b AS start, e AS "end", r AS val, CASE WHEN (s + qn) % 4 <> 0 THEN label END AS fp, form FROM h
  UNION ALL SELECT s, y, qn, e, 0, 'Revenues', 'revenue', yb, e, ytd, CASE WHEN k = 4 THEN 'FY' ELSE label END, form FROM h
  UNION ALL SELECT s, y, qn, e, 365, 'Revenues', 'revenue', yb, e, ytd + 100, 'FY', form FROM h WHERE k = 4
  UNION ALL SELECT s, y, qn, e, 0, 'Segments', 'net_income', b, b + 44, n, label, form FROM h UNION ALL SELECT s, y, qn, e, 0, 'Segments', 'net_income', b + 45, e, n * 2, label, form FROM h
  UNION ALL SELECT s, y, qn, e, 0, 'Parts', 'capex_cash', b + CAST(k % 2 * 3 AS INT), b + 44, n * 3, NULL, '8-K' FROM h UNION ALL SELECT s, y, qn, e, 0, 'Parts', 'capex_cash', b + 45, e, n * 4, NULL, '8-K' FROM h),
rw AS (SELECT s AS cik, metric_key, tag, start, "end", CAST(val AS DOUBLE) AS val, f + 30 + later AS filed, s || '-' || qn || '-' || later AS accn, y + CASE WHEN (s + y) % 7 = 0 THEN 1 ELSE 0 END AS fy, fp, form,
  CASE WHEN tag = 'Segments' THEN 'quarter' WHEN tag = 'Parts' THEN 'other' WHEN "end" - start + 1 >= 330 THEN 'annual' WHEN "end" - start + 1 >= 120 THEN 'ytd' ELSE 'quarter' END AS kind FROM fx),
ea AS (SELECT x.*, p.f, p."end" AS pe, p.val AS pv, row_number() OVER (PARTITION BY x.cik, x.metric_key, x.tag, x.start, x."end", x.val, x.filed, x.accn ORDER BY p."end" DESC, p.f DESC, p.val DESC) AS o
  FROM rw x JOIN (SELECT *, filed AS f FROM rw WHERE kind IN ('quarter', 'ytd') AND val IS NOT NULL) p ON p.cik = x.cik AND p.metric_key = x.metric_key AND p.tag = x.tag AND p.start = x.start AND p."end" < x."end" WHERE x.kind = 'ytd' OR (x.kind = 'annual' AND x.form NOT IN ('8-K', '6-K'))),
la AS (SELECT x.*, p.start AS ps, p.val AS pv, row_number() OVER (PARTITION BY x.cik, x.metric_key, x.tag, x.start, x."end", x.val, x.filed, x.accn ORDER BY p.start, p.filed DESC, p.val DESC) AS o
  FROM rw x JOIN rw p ON p.cik = x.cik AND p.metric_key = x.metric_key AND p.tag = x.tag AND p."end" = x."end" AND p.start > x.start AND p.kind = 'quarter' AND p.val IS NOT NULL WHERE x.kind = 'ytd'),
sg AS (SELECT *, coalesce(abs(start - lag("end") OVER (PARTITION BY cik, accn, filed, fy, fp ORDER BY start, "end", val) - 1) > 1, false) AS gap FROM rw WHERE tag = 'Segments' AND fy IS NOT NULL),
pf AS (SELECT *, CASE WHEN abs(start - lag("end") OVER (PARTITION BY cik, metric_key ORDER BY start, "end", tag, accn, val) - 1) <= 1 THEN 0 ELSE 1 END AS fresh FROM rw WHERE kind = 'other' AND val IS NOT NULL),
pc AS (SELECT *, sum(fresh) OVER (PARTITION BY cik, metric_key ORDER BY start, "end", tag, accn, val ROWS UNBOUNDED PRECEDING) AS chain FROM pf),
pp AS (SELECT * EXCLUDE (val, start), row_number() OVER w AS place, sum(val) OVER w AS val, first(start) OVER w AS start FROM pc WINDOW w AS (PARTITION BY cik, metric_key, chain ORDER BY start, "end", tag, accn, val ROWS UNBOUNDED PRECEDING))"""
SQL["stored_calendars"], SQL["stored_regimes"] = SQL["fiscal_windows"], SQL["fiscal_history"]
_LOW, _HIGH = periods.QUARTER_LENGTH
SQL["rebuilt_rows"] = f"""WITH {_STATED}
SELECT cik, metric_key, tag, CAST(pe + 1 AS DATE) AS start, "end", round(val - pv, 4) AS val, filed, accn, CASE WHEN kind = 'annual' THEN 'annual_derived' ELSE 'cumulative_derived' END AS source_kind, 'earlier' AS way, 0 AS place FROM ea WHERE o = 1 AND "end" - pe BETWEEN {_LOW} AND {_HIGH}
UNION ALL SELECT cik, metric_key, tag, start, CAST(ps - 1 AS DATE), round(val - pv, 4), filed, accn, 'cumulative_derived', 'later', 0 FROM la WHERE o = 1 AND ps - start BETWEEN {_LOW} AND {_HIGH}
UNION ALL SELECT cik, metric_key, tag, min(start), max("end"), round(sum(val), 4), filed, accn, 'segment_merged', 'segment', 0 FROM sg GROUP BY cik, metric_key, tag, accn, filed, fy, fp HAVING count(*) > 1 AND NOT bool_or(gap)
UNION ALL SELECT cik, metric_key, tag, start, "end", round(val, 4), filed, accn, 'other_merged', 'prefix', CAST(place AS INT) FROM pp WHERE place > 1"""
