"""Series, as-of joins, enrichment and reliability: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import filings
from tidemark.operators import enrichment, relational
from tidemark.plans import sql
from tidemark.plans.common import rounded
from tidemark.session import if_small
from tidemark.sources import adapters

TRACKED = [
    "val", "yoy", "qoq", "ttm_val", "rolling4_avg", "duration_adjusted_val", "duration_adjusted_yoy", "duration_adjusted_qoq",
    "duration_adjusted_ttm_val", "duration_adjusted_rolling4_avg",
]
_ADJUSTED = {f"duration_adjusted_{c}": 2 for c in ("val", "ttm_val", "ttm_delta", "rolling4_avg")}


def flow_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich_flow(adapters.flow_series(spark, sf_dir))


def growth_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each supplier's latest trailing revenue, its growth, and whether growth speeds up."""
    e = flow_enriched(spark, sf_dir).where("metric_key = 'revenue'")
    latest = relational.latest_by(e, ["cik"], [F.desc("end")])
    shown = latest.select("cik", "ticker", "end", "val", "ttm_val", "ttm_yoy", "yoy", "qoq", "yoy_delta", (F.col("yoy_delta") > 0).alias("is_accelerating"))
    return rounded(shown)


def flow_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow_enriched(spark, sf_dir), **_ADJUSTED)


def instant_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(enrichment.enrich_instant(adapters.instant_series(spark, sf_dir)))


def series_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = enrichment.reliability(flow_enriched(spark, sf_dir), TRACKED)
    return rounded(told.select("cik", "metric_key", "end", "observation_depth", "fiscal_continuity", "input_coverage"))


def asof_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last macro observation at or before each period end, per series."""
    rows = adapters.flow_series(spark, sf_dir).where("metric_key = 'revenue'").select("cik", "end", "val")
    series = adapters.macro(spark, sf_dir).where("value is not null")
    names = F.explode(F.array(*map(F.lit, ("rate", "spread", "vix")))).alias("series_id")
    # companies share their period ends: each end is looked up once
    ends = relational.as_of(rows.select("end").distinct().select("end", names), series, ["series_id"], "end", "observation_date")
    return rows.select("*", names).join(if_small(ends), ["series_id", "end"])


def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's last bar on or before its filing became known."""
    rows = adapters.flow_series(spark, sf_dir).where("metric_key = 'revenue'").select("cik", "effective_date")
    listed = adapters.companies(spark, sf_dir).select("cik", F.col("listed").alias("ticker"))
    left = rows.join(if_small(listed), "cik")
    return relational.as_of(left, adapters.bars(spark, sf_dir).select("ticker", "price_date", "close"), ["ticker"], "effective_date", "price_date")


def forward_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar on or after each quarter's end, 1, 3, 6 and 12 months on (overflowing months)."""
    bars = adapters.bars(spark, sf_dir)
    dates = bars.select("ticker").distinct().withColumn("base", F.explode(F.expr("sequence(date'1997-03-31', date'2000-12-31', interval 3 month)")))
    dates = dates.withColumn("months", F.explode(F.array(*map(F.lit, (0, 1, 3, 6, 12))))).withColumn("target", cal.add_months_overflow(F.col("base"), F.col("months")))
    return relational.first_on_or_after(dates, bars, ["ticker"], "target", "price_date", "close")


def bitemporal_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each company's revenue at each year's end."""
    rows = adapters.flow_series(spark, sf_dir).where("metric_key = 'revenue'").select("cik", "end", "effective_date", "val")
    shots = spark.sql("select explode(sequence(date'1995-12-31', date'2001-12-31', interval 1 year)) as as_of")
    return relational.bitemporal_latest(rows, shots, ["cik"])


def replaced_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recomputed slice (one metric doubled) replaces the stored one."""
    stored = adapters.flow_series(spark, sf_dir).select("cik", "metric_key", "end", "val")
    fresh = stored.where("metric_key = 'revenue'").withColumn("val", F.col("val") * 2)
    return relational.replace_slice(stored, fresh, ["metric_key"])


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as keyed upserts: per customer and status the last one written stands."""
    orders = adapters.table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return relational.last_wins(orders, ["o_custkey", "o_orderstatus"], "o_orderkey")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest orders of every customer, ties by price and key."""
    orders = adapters.table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).withColumn("o_orderdate", adapters.date_of("o_orderdate"))
    return relational.latest_by(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar functions over the distinct order dates."""
    d = F.col("d")
    days = adapters.table(spark, sf_dir, "orders", ["o_orderdate"]).select(adapters.date_of("o_orderdate").alias("d")).distinct()
    return days.select(
        "d", cal.add_months_overflow(d, 1).alias("plus_1"), cal.add_months_overflow(d, 3).alias("plus_3"), cal.previous_year_date(d).alias("year_before"),
        cal.previous_period_end(d, "month").alias("month_end_before"), cal.previous_period_end(d, "quarter").alias("quarter_end_before"),
        cal.previous_period_end(d, "year").alias("year_end_before"), cal.is_month_end(d).alias("is_month_end"), cal.weekday(d).cast("int").alias("weekday"),
        cal.quarter_label(d).alias("quarter_label"), cal.fiscal_year_of_end(d).alias("fiscal_year"), cal.is_next_day(d, F.date_add(d, 1)).alias("next"),
        F.array_contains(cal.market_holidays(F.year(d)), d).alias("is_holiday"),
        F.size(cal.snapshot_dates(F.lit("1995-01-01").cast("date"), d)).alias("n_quarter_ends"),
    )


def filing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label classifiers over strings and lengths made from line items' keys."""
    rows = adapters.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    forms = F.array(*map(F.lit, ("10-K", "10-k/A", "20-F", "10-Q", " 10-q", "8-K", "6-K/A", "S-1")))
    frames = F.array(*map(F.lit, ("CY2020", "CY2019Q1", "CY2018Q3I", "2020", "CY20Q1")))
    k = F.col("l_orderkey").cast("int")
    df = rows.select(
        "l_orderkey", "l_linenumber", F.element_at(forms, k % 8 + 1).alias("form"), F.concat(F.lit("q"), (k % 6).cast("string")).alias("fp"),
        F.element_at(frames, k % 5 + 1).alias("frame"), ((k * 7 + F.col("l_linenumber") * 13) % 420).alias("days"),
    )
    part = filings.frame_parts(F.col("frame"))
    return df.select(
        "l_orderkey", "l_linenumber", filings.form_hint(F.col("form")).alias("form_hint"), filings.period_hint(F.col("fp")).alias("period_hint"),
        filings.period_quarter(F.col("fp")).alias("quarter"), part["year"].alias("frame_year"), part["quarter"].alias("frame_quarter"), part["instant"].alias("frame_instant"),
        filings.duration_class(F.col("days")).alias("duration_class"), filings.padded_cik(F.col("l_orderkey")).alias("cik"),
    )


QUERIES = {f.__name__: f for f in (
    growth_leaders, flow_enrichment, instant_enrichment, series_reliability, asof_macro, asof_price, forward_price, bitemporal_snapshots,
    replaced_slice, upsert_last_wins, latest_rows, date_functions, filing_labels,
)}


def _enriched(split: str = "cik, metric_key") -> str:
    k = ", ".join(split.split(", "))
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in split.split(", "))
    return f"""{sql.FLOW},
b AS (
  SELECT *, fiscal_year * 4 + fiscal_quarter - 1 AS idx, row_number() OVER p AS rn,
         "end" - lag("end") OVER p AS gap, "end" - lag("end", 3) OVER p AS span,
         CASE WHEN metric_key = 'revenue' AND duration_days > 0 THEN val / duration_days * 91 END AS duration_adjusted_val
  FROM flow WINDOW p AS (PARTITION BY {k} ORDER BY "end")),
own AS (SELECT * FROM b WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k}, idx ORDER BY "end" DESC) = 1),
strict4 AS (
  SELECT b.cik, b.metric_key, b.rn, sum(o.val) AS v, sum(o.duration_adjusted_val) AS a, count(o.duration_adjusted_val) AS na, min(o."end") AS ws, max(o."end") AS we, max(o.effective_date) AS known
  FROM b JOIN own o ON {on('b', 'o')} AND o.idx BETWEEN b.idx - 3 AND b.idx AND o.val IS NOT NULL
  GROUP BY 1, 2, 3 HAVING count(*) = 4),
chain4 AS (
  SELECT b.cik, b.metric_key, b.rn, sum(o.val) AS v, sum(o.duration_adjusted_val) AS a, count(o.duration_adjusted_val) AS na, min(o."end") AS ws, max(o."end") AS we, max(o.effective_date) AS known
  FROM b JOIN b o ON {on('b', 'o')} AND o.rn BETWEEN b.rn - 3 AND b.rn
  WHERE b.span BETWEEN 240 AND 430
  GROUP BY 1, 2, 3 HAVING count(*) = 4 AND bool_and(o.gap BETWEEN 60 AND 130 OR o.rn = b.rn - 3)),
t AS (
  SELECT b.*, coalesce(s.v, c.v) AS ttm_val, CASE WHEN s.v IS NOT NULL THEN 'strict_fiscal_quarters' WHEN c.v IS NOT NULL THEN 'comparable_date_gap' END AS ttm_kind,
         CASE WHEN s.v IS NOT NULL THEN CASE WHEN s.na = 4 THEN s.a END WHEN c.na = 4 THEN c.a END AS duration_adjusted_ttm_val,
         coalesce(s.ws, c.ws) AS ws, coalesce(s.we, c.we) AS we, coalesce(s.known, c.known) AS tknown
  FROM b LEFT JOIN strict4 s ON {on('b', 's')} AND b.rn = s.rn LEFT JOIN chain4 c ON {on('b', 'c')} AND b.rn = c.rn),
ownt AS (SELECT t.* FROM t JOIN own USING (cik, metric_key, rn)),
dated AS (
  SELECT x.cik, x.metric_key, x.rn, y.rn AS yrn
  FROM t x JOIN t y ON {on('x', 'y')} AND x."end" - y."end" BETWEEN 320 AND 410 AND y.val IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x.cik, x.metric_key, x.rn ORDER BY abs(x."end" - y."end" - 365), x."end" - y."end") = 1),
y AS (
  SELECT x.*, coalesce(s.rn, d.yrn) AS yrn, CASE WHEN s.rn IS NOT NULL THEN 'strict_fiscal_quarter' WHEN d.yrn IS NOT NULL THEN 'comparable_date_gap' END AS ykind
  FROM t x LEFT JOIN ownt s ON {on('x', 's')} AND s.idx = x.idx - 4 LEFT JOIN dated d ON {on('x', 'd')} AND d.rn = x.rn),
z AS (
  SELECT y.*, p."end" AS yend, p.val AS yval, p.duration_adjusted_val AS yadj, p.ttm_val AS yttm, p.duration_adjusted_ttm_val AS yattm, p.ttm_kind AS yttm_kind, p.ws AS yws, p.we AS ywe,
         greatest(p.effective_date, p.tknown) AS yknown,
         CASE WHEN p.val <> 0 THEN (y.val - p.val) / abs(p.val) END AS yoy,
         CASE WHEN p.duration_adjusted_val <> 0 THEN (y.duration_adjusted_val - p.duration_adjusted_val) / abs(p.duration_adjusted_val) END AS ayoy
  FROM y LEFT JOIN t p ON {on('y', 'p')} AND p.rn = y.yrn),
ownz AS (SELECT z.* FROM z JOIN own USING (cik, metric_key, rn)),
v AS (
  SELECT z.*, coalesce(s.rn, d.rn) AS prn, CASE WHEN s.rn IS NOT NULL THEN 'strict_fiscal_quarter' WHEN d.rn IS NOT NULL THEN 'comparable_date_gap' END AS pkind
  FROM z LEFT JOIN ownz s ON {on('z', 's')} AND s.idx = z.idx - 1 LEFT JOIN z d ON {on('z', 'd')} AND d.rn = z.rn - 1 AND z.gap BETWEEN 60 AND 130),
e AS (
  SELECT v.cik, v.ticker, v.metric_key, v.fact_type, v.unit, v.val, v.start, v."end", v.filed,
    greatest(v.effective_date, p.effective_date, v.yknown, v.tknown) AS effective_date, v.duration_days, v.fiscal_year, v.fiscal_quarter, v.period_type,
    v.duration_adjusted_val, v.ttm_val, v.duration_adjusted_ttm_val, v.yoy, v.ayoy AS duration_adjusted_yoy,
    CASE WHEN p.val <> 0 THEN (v.val - p.val) / abs(p.val) END AS qoq,
    CASE WHEN p.duration_adjusted_val <> 0 THEN (v.duration_adjusted_val - p.duration_adjusted_val) / abs(p.duration_adjusted_val) END AS duration_adjusted_qoq,
    CASE WHEN p.idx IS NOT NULL THEN v.yoy - p.yoy END AS yoy_delta, CASE WHEN p.idx IS NOT NULL THEN v.ayoy - p.ayoy END AS duration_adjusted_yoy_delta,
    CASE WHEN v.yttm <> 0 THEN (v.ttm_val - v.yttm) / abs(v.yttm) END AS ttm_yoy, v.ttm_val - v.yttm AS ttm_delta,
    CASE WHEN v.yattm <> 0 THEN (v.duration_adjusted_ttm_val - v.yattm) / abs(v.yattm) END AS duration_adjusted_ttm_yoy, v.duration_adjusted_ttm_val - v.yattm AS duration_adjusted_ttm_delta,
    v.ttm_val / 4 AS rolling4_avg, v.duration_adjusted_ttm_val / 4 AS duration_adjusted_rolling4_avg,
    v.yval < 0 AND v.val > 0 AS is_turnaround, v.yval > 0 AND v.val < 0 AS is_deterioration, v.yval < 0 AND v.val < 0 AND v.val > v.yval AS is_loss_narrowing,
    v.ykind, v.yend, p."end" AS pend, v.pkind, v.ttm_kind, v.ws, v.we, v.yttm_kind, v.yws, v.ywe
  FROM v LEFT JOIN z p ON {on('v', 'p')} AND p.rn = v.prn),
enriched AS (
  SELECT * EXCLUDE (ykind, yend, pend, pkind, ttm_kind, ws, we, yttm_kind, yws, ywe),
    ttm_kind AS ttm_source_kind, CASE WHEN yoy IS NOT NULL THEN ykind END AS yoy_source_kind, CASE WHEN yoy IS NOT NULL THEN yend END AS yoy_base_period_end,
    CASE WHEN qoq IS NOT NULL THEN pkind END AS qoq_source_kind, CASE WHEN qoq IS NOT NULL THEN pend END AS qoq_base_period_end,
    CASE WHEN ttm_val IS NOT NULL THEN ws END AS ttm_window_start, CASE WHEN ttm_val IS NOT NULL THEN we END AS ttm_window_end,
    CASE WHEN ttm_yoy IS NOT NULL THEN CASE WHEN ttm_kind = 'strict_fiscal_quarters' AND yttm_kind = 'strict_fiscal_quarters' THEN 'strict_fiscal_quarters' ELSE 'comparable_date_gap' END END AS ttm_yoy_source_kind,
    CASE WHEN ttm_yoy IS NOT NULL THEN yws END AS ttm_yoy_base_window_start, CASE WHEN ttm_yoy IS NOT NULL THEN ywe END AS ttm_yoy_base_window_end
  FROM e)"""


ENRICHED = _enriched()
_FLOAT = {
    "val": 6, "yoy": 6, "qoq": 6, "yoy_delta": 6, "ttm_val": 6, "ttm_yoy": 6, "ttm_delta": 6, "rolling4_avg": 6, "duration_adjusted_yoy": 6, "duration_adjusted_qoq": 6,
    "duration_adjusted_yoy_delta": 6, "duration_adjusted_ttm_yoy": 6, **_ADJUSTED,
}
_REPLACE = ", ".join(f"round({c}, {n}) AS {c}" for c, n in _FLOAT.items())
_NEAR = """
  SELECT x.cik, x.metric_key, x.rn, y.rn AS yrn FROM b x JOIN b y ON x.cik = y.cik AND x.metric_key = y.metric_key AND x."end" - y."end" BETWEEN 320 AND 410 AND y.val IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x.cik, x.metric_key, x.rn ORDER BY abs(x."end" - y."end" - 365), x."end" - y."end") = 1"""

SQL = {
    "growth_leaders": f"""WITH {ENRICHED}
SELECT cik, ticker, "end", round(val, 6) AS val, round(ttm_val, 6) AS ttm_val, round(ttm_yoy, 6) AS ttm_yoy, round(yoy, 6) AS yoy, round(qoq, 6) AS qoq, round(yoy_delta, 6) AS yoy_delta, yoy_delta > 0 AS is_accelerating
FROM enriched WHERE metric_key = 'revenue' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) = 1""",
    "flow_enrichment": f"WITH {ENRICHED} SELECT * REPLACE ({_REPLACE}) FROM enriched",
    "instant_enrichment": f"""WITH {sql.INSTANT},
b AS (SELECT *, fiscal_year * 4 + fiscal_quarter - 1 AS idx, row_number() OVER p AS rn, "end" - lag("end") OVER p AS gap FROM instant WINDOW p AS (PARTITION BY cik, metric_key ORDER BY "end")),
near AS ({_NEAR}),
y AS (
  SELECT b.*, coalesce(s.rn, n.yrn) AS yrn, CASE WHEN s.rn IS NOT NULL THEN 'strict_fiscal_quarter' WHEN n.yrn IS NOT NULL THEN 'comparable_date_gap' END AS ykind
  FROM b LEFT JOIN b s ON b.cik = s.cik AND b.metric_key = s.metric_key AND s.idx = b.idx - 4 LEFT JOIN near n ON n.cik = b.cik AND n.metric_key = b.metric_key AND n.rn = b.rn),
z AS (SELECT y.*, p."end" AS yend, p.effective_date AS yknown, CASE WHEN p.val <> 0 THEN (y.val - p.val) / abs(p.val) END AS yoy FROM y LEFT JOIN b p ON y.cik = p.cik AND y.metric_key = p.metric_key AND p.rn = y.yrn),
f AS (
  SELECT z.*, p."end" AS pend, p.effective_date AS pknown, CASE WHEN p.val <> 0 THEN (z.val - p.val) / abs(p.val) END AS qoq, z.yoy - p.yoy AS yoy_delta,
    CASE WHEN z.rn >= 4 THEN sum(z.val) OVER w / 4 END AS rolling4_avg, CASE WHEN z.rn >= 4 THEN max(z.effective_date) OVER w END AS wknown
  FROM z LEFT JOIN z p ON z.cik = p.cik AND z.metric_key = p.metric_key AND p.rn = z.rn - 1 AND z.gap BETWEEN 60 AND 130
  WINDOW w AS (PARTITION BY z.cik, z.metric_key ORDER BY z."end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT cik, ticker, metric_key, fact_type, unit, round(val, 6) AS val, start, "end", filed, greatest(effective_date, yknown, pknown, wknown) AS effective_date, duration_days, fiscal_year, fiscal_quarter, period_type,
  round(yoy, 6) AS yoy, round(qoq, 6) AS qoq, round(yoy_delta, 6) AS yoy_delta, round(rolling4_avg, 6) AS rolling4_avg, CASE WHEN yoy IS NOT NULL THEN ykind END AS yoy_source_kind, CASE WHEN yoy IS NOT NULL THEN yend END AS yoy_base_period_end,
  CASE WHEN qoq IS NOT NULL THEN 'comparable_date_gap' END AS qoq_source_kind, CASE WHEN qoq IS NOT NULL THEN pend END AS qoq_base_period_end
FROM f""",
    "series_reliability": f"""WITH {ENRICHED},
s AS (SELECT *, (fiscal_year * 4 + fiscal_quarter - lag(fiscal_year * 4 + fiscal_quarter) OVER (PARTITION BY cik, metric_key ORDER BY "end") = 1)::INT AS step, row_number() OVER (PARTITION BY cik, metric_key ORDER BY "end") AS n FROM enriched)
SELECT cik, metric_key, "end", round(least(1.0, n / 8), 6) AS observation_depth,
  round(avg(step) OVER (PARTITION BY cik, metric_key ORDER BY "end" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS fiscal_continuity,
  round(({' + '.join(f'({c} IS NOT NULL)::INT' for c in TRACKED)}) / 10, 6) AS input_coverage FROM s""",
    "asof_macro": f"""WITH {sql.FLOW}, {sql.MACRO.strip()},
l AS (SELECT cik, "end", val, series_id FROM flow, (VALUES ('rate'), ('spread'), ('vix')) s(series_id) WHERE metric_key = 'revenue'),
m AS (SELECT * FROM macro WHERE value IS NOT NULL)
SELECT l.cik, l."end", l.val, l.series_id, m.observation_date, m.value FROM l ASOF LEFT JOIN m ON l.series_id = m.series_id AND l."end" >= m.observation_date""",
    "asof_price": f"""WITH {sql.FLOW}, {sql.COMPANIES.strip()}, {sql.BARS.strip()},
l AS (SELECT f.cik, f.effective_date, c.listed AS ticker FROM flow f JOIN companies c USING (cik) WHERE metric_key = 'revenue')
SELECT l.cik, l.effective_date, l.ticker, b.price_date, b.close FROM l ASOF LEFT JOIN bars b ON l.ticker = b.ticker AND l.effective_date >= b.price_date""",
    "forward_price": f"""WITH {sql.BARS.strip()},
base AS (SELECT DISTINCT ticker FROM bars),
d AS (SELECT ticker, CAST(x AS DATE) AS base, months, CAST(date_trunc('month', x) + to_months(months) + to_days(CAST(day(x) - 1 AS INT)) AS DATE) AS target
      FROM base, (SELECT DATE '1997-03-31' + to_months(3 * CAST(i AS INT)) AS x FROM range(16) r(i)), (VALUES (0), (1), (3), (6), (12)) m(months))
SELECT d.ticker, d.base, d.months, d.target, b.price_date, b.close FROM d ASOF JOIN bars b ON d.ticker = b.ticker AND d.target <= b.price_date WHERE b.close > 0""",
    "bitemporal_snapshots": f"""WITH {sql.FLOW}, s AS (SELECT CAST(DATE '1995-12-31' + to_years(CAST(i AS INT)) AS DATE) AS as_of FROM range(7) r(i))
SELECT cik, "end", effective_date, val, as_of FROM flow JOIN s ON effective_date <= as_of WHERE metric_key = 'revenue'
QUALIFY row_number() OVER (PARTITION BY cik, as_of ORDER BY effective_date DESC, "end" DESC) = 1""",
    "replaced_slice": f"WITH {sql.FLOW} SELECT cik, metric_key, \"end\", CASE WHEN metric_key = 'revenue' THEN val * 2 ELSE val END AS val FROM flow",
    "upsert_last_wins": "SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2",
    "latest_rows": """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice DESC, o_orderkey) <= 3""",
    "date_functions": """WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
y AS (SELECT DISTINCT year(d) AS y FROM t),
f AS (SELECT y, make_date(y, 1, 1) AS jan, make_date(y, 7, 4) AS jul, make_date(y, 12, 25) AS dec FROM y),
e AS (SELECT * FROM (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')) v(y, sunday)),
h AS (
  SELECT CASE dayofweek(jan) WHEN 6 THEN NULL WHEN 0 THEN jan + 1 ELSE jan END AS d FROM f
  UNION ALL SELECT CASE dayofweek(jul) WHEN 6 THEN jul - 1 WHEN 0 THEN jul + 1 ELSE jul END FROM f
  UNION ALL SELECT CASE dayofweek(dec) WHEN 6 THEN dec - 1 WHEN 0 THEN dec + 1 ELSE dec END FROM f
  UNION ALL SELECT CAST(sunday - 2 AS DATE) FROM e
  UNION ALL SELECT CAST(x AS DATE) FROM (SELECT unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS x FROM y)
    WHERE (dayofweek(x) = 1 AND ((month(x) IN (1, 2) AND day(x) BETWEEN 15 AND 21) OR (month(x) = 5 AND day(x) >= 25) OR (month(x) = 9 AND day(x) <= 7))) OR (dayofweek(x) = 4 AND month(x) = 11 AND day(x) BETWEEN 22 AND 28))
SELECT d, CAST(date_trunc('month', d) + INTERVAL 1 MONTH + to_days(CAST(day(d) - 1 AS INT)) AS DATE) AS plus_1, CAST(date_trunc('month', d) + INTERVAL 3 MONTH + to_days(CAST(day(d) - 1 AS INT)) AS DATE) AS plus_3,
  CASE WHEN NOT (month(d) = 2 AND day(d) = 29) THEN make_date(year(d) - 1, month(d), day(d)) END AS year_before,
  CAST(date_trunc('month', d) - INTERVAL 1 DAY AS DATE) AS month_end_before, CAST(date_trunc('quarter', d) - INTERVAL 1 DAY AS DATE) AS quarter_end_before, CAST(date_trunc('year', d) - INTERVAL 1 DAY AS DATE) AS year_end_before,
  d = last_day(d) AS is_month_end, CAST(dayofweek(d) AS INT) AS weekday, strftime(d, '%y') || 'Q' || quarter(d) AS quarter_label,
  CAST(CASE WHEN month(d) = 1 AND day(d) <= 7 THEN year(d) - 1 ELSE year(d) END AS INT) AS fiscal_year, true AS next, d IN (SELECT h.d FROM h WHERE h.d IS NOT NULL) AS is_holiday,
  CAST((year(d) - 1995) * 4 + quarter(d) - CASE WHEN d = last_day(d) AND month(d) % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_quarter_ends
FROM t""",
    "filing_labels": """WITH t AS (
  SELECT l_orderkey, l_linenumber, ['annual', 'annual', 'annual', 'quarter', 'quarter', 'current', 'current', 'unknown'][CAST(l_orderkey % 8 + 1 AS INT)] AS form_hint,
    l_orderkey % 6 AS q, l_orderkey % 5 AS f, (l_orderkey * 7 + l_linenumber * 13) % 420 AS days FROM lineitem)
SELECT l_orderkey, l_linenumber, form_hint, CASE WHEN q BETWEEN 1 AND 4 THEN 'quarter' ELSE 'unknown' END AS period_hint, CAST(CASE WHEN q BETWEEN 1 AND 4 THEN q END AS INT) AS quarter,
  CAST(CASE f WHEN 0 THEN 2020 WHEN 1 THEN 2019 WHEN 2 THEN 2018 END AS INT) AS frame_year, CAST(CASE f WHEN 1 THEN 1 WHEN 2 THEN 3 END AS INT) AS frame_quarter, CASE WHEN f <= 2 THEN f = 2 END AS frame_instant,
  CASE WHEN days = 0 THEN 'instant' WHEN days BETWEEN 330 AND 400 THEN 'annual' WHEN days BETWEEN 75 AND 120 THEN 'quarter' WHEN days BETWEEN 130 AND 300 THEN 'ytd' ELSE 'other' END AS duration_class,
  lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS cik FROM t""",
}
