"""Matched families, samples, symbols, sessions and registry trees: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, methodology, sampling, sessions, signals, structure, symbols, timeline
from tidemark.operators import rules as stored_rules
from tidemark.plans import fiscal_queries
from tidemark.plans import signal_queries as sq
from tidemark.plans import sql
from tidemark.plans import structure_queries as tq
from tidemark.plans.common import rounded
from tidemark.plans.registry import QUESTIONS, default_features, default_signals
from tidemark.sources import adapters, facts

GRID = ([0.7, 0.8], [0.8, 0.9])
FIRST, LAST, STEPS = "1995-01-01", "2002-12-31", (5, 21, 63)
BUCKET = ("latestGrowth", "durableGrowth", "netMargin", "trendStretch", "annualStretch", "decline")
LABELS = {"growth": "Growth", "growth.latestGrowth": "Latest growth", "quality.declining": "Declining business"}


def matched_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest overlaps of Jaccard and Hamming families where the two agree best."""
    found, pairs = tq._graph(spark, sf_dir)
    at = structure.best_cell(structure.partition_grid(found, pairs, *GRID))
    told = structure.matched_families(found, structure.families(found, pairs, at[0]), structure.families(found, pairs, at[1], "hamming"))
    return rounded(told.withColumn("top_tokens", F.concat_ws(",", "top_tokens")))


def family_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve entities of each family, drawn by lot; put together from the samples of two halves of the entities."""
    found, pairs = tq._graph(spark, sf_dir)
    labels = structure.families(found, pairs, 0.8)
    vectors = structure.state_vectors(signals.build(sq._features(spark, sf_dir), default_signals()), QUESTIONS)
    members = vectors.join(found.select("state_vector", "idx"), "state_vector").join(labels, "idx").select("label", "entity")
    half = F.substring("entity", 10, 1).cast("int") % 2 == 0
    told = sampling.merged(*(sampling.bottom_k(members.where(side), ["label"], "entity", 12) for side in (half, ~half)), ["label"], 12)
    return told.select("label", "entity", "place")


def provider_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers and a catalog made of parts, resolved by rank."""
    part = adapters.table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_brand"])
    k = F.col("p_partkey")
    letter = lambda n: F.char(65 + F.floor(n) % 26)
    base = F.concat(letter(k), letter(k / 26), F.lit("X"))
    rows = part.withColumns({"base": base, "c": F.char(65 + k % 5)})
    catalog = rows.where("p_partkey % 7 <> 0").select(
        k.alias("listing"), F.when(k % 3 == 0, F.concat("base", F.lit("."), "c")).when(k % 11 == 1, F.lower("base")).otherwise(F.col("base")).alias("symbol"),
        F.when(F.col("p_size") % 4 == 0, "NYSE").when(F.col("p_size") % 4 == 1, "NASDAQ").when(F.col("p_size") % 4 == 2, "OTC").alias("exchange"),
        F.when(F.col("p_brand").endswith("5"), "etf").otherwise("stock").alias("kind"),
    )
    asked = rows.select(F.when(k % 4 == 0, F.col("base")).when(k % 4 == 1, F.concat("base", "c")).when(k % 4 == 2, F.concat(F.lit(" "), F.lower("base"), F.lit("-"), F.lower("c"))).otherwise(F.concat("base", F.lit("Q"))).alias("ticker"))
    return symbols.resolve(asked, catalog).withColumn("candidates", F.concat_ws(",", "candidates"))


def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of every order day: its ordinal, and how many sessions it is before the last order day's."""
    calendar = sessions.sessions(spark, FIRST, LAST)
    days = adapters.table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    last = days.agg(F.max("day").alias("last_day"))
    told = sessions.sessions_between(days.crossJoin(F.broadcast(last)), calendar, "day", "last_day", "to_last")
    told = sessions.session_of(told, calendar, "day").join(F.broadcast(calendar.select("ordinal", "session", "early_close", "opens_at", "closes_at")), "ordinal")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return told.select("day", "session", "ordinal", "to_last", "early_close", text("opens_at"), text("closes_at"))


def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of every brand from each quarter end to 5, 21 and 63 sessions later."""
    bars, calendar = adapters.bars(spark, sf_dir), sessions.sessions(spark, FIRST, LAST)
    members = bars.select("ticker").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in sq.QUARTERS])))
    return rounded(sessions.forward_session_returns(members, bars, calendar, STEPS))


def registry_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a factor: its axes, their features with the metrics and companies that have them, and their signals, as JSON."""
    stored = stored_rules.read(stored_rules.store(spark, default_signals().signals))
    told = methodology.registry_tree(features.registry_frame(spark, default_features()), stored.definitions, sq._features(spark, sf_dir), LABELS)
    return told.withColumn("axes", F.to_json("axes"))


def feature_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features in which the companies of one region differ most from all others."""
    latest = features.latest_features(sq._features(spark, sf_dir)).join(adapters.companies(spark, sf_dir).select("cik", "sector"), "cik")
    return rounded(structure.feature_audit(latest, F.col("sector") == "ASIA"))


def covered_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter ends at which every question of both axes is answered by half of the companies of the last one."""
    return timeline.covered_dates(tq._signals_at(spark, sf_dir))


def bucket_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company and question the median over a bucket of features."""
    told = signals.build(sq._features(spark, sf_dir), default_signals())
    return rounded(told.select("entity", "factor", "axis", signals.bucket_median(F.col("feature_values"), list(BUCKET)).alias("bucket_value")))


def facts_by_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed facts of two tags and two forms; absent parameters filter nothing."""
    told = facts.facts_of(fiscal_queries._filings(spark, sf_dir), tags=["Revenues", "Parts"], forms=["10-K", "8-K"])
    return rounded(told.select("cik", "tag", "start", "end", "val", "form", "filed", "accn"), 4)


def stale_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose vendor tables are missing or old, the dates of which come from their last line items."""
    last = adapters.table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate"]).groupBy("l_suppkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("d"))
    s = F.col("l_suppkey")
    rows = last.select(s, F.concat(F.lit("S"), s).alias("ticker"), F.date_sub("d", (s % 40).cast("int")).alias("a"), F.date_sub("d", (s % 23).cast("int")).alias("b"))
    members = rows.select("ticker", F.when(s % 3 == 0, "one").otherwise("two").alias("universe_key"), (s % 11 != 0).alias("is_active"))
    tables = {"identity": rows.where(s % 7 != 0).select("ticker", F.col("a").alias("fetched_at")), "profile": rows.where(s % 5 != 0).select("ticker", F.when(s % 13 != 0, F.col("b")).alias("fetched_at"))}
    return facts.stale_candidates(members, tables, ["one", "two"], "2001-10-20")


QUERIES = {f.__name__: f for f in (matched_families, family_samples, provider_symbols, session_calendar, session_returns, registry_tree, feature_shifts, covered_quarters, bucket_medians, facts_by_parameter, stale_profiles)}

_GRID_SQL = tq._agreement_sql(*GRID)
_RANKED = """{n}f AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS family, count(*) AS groups FROM {n}_l GROUP BY 1)"""


def _matched_sql() -> str:
    labels = lambda name, lens, cell: f"""{name}_e AS (SELECT a, b FROM ham, cell WHERE {lens} > 0 AND {lens} >= {cell} UNION SELECT b, a FROM ham, cell WHERE {lens} > 0 AND {lens} >= {cell}),
{name}_r(node, reached) AS (SELECT idx, idx FROM gr UNION SELECT r.node, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.reached), {name}_l AS (SELECT node AS idx, min(reached) AS label FROM {name}_r GROUP BY 1)"""  # noqa: E731
    return f"""{tq._PAIRS}, cell AS (SELECT jaccard_t, hamming_t FROM ({_GRID_SQL}) ORDER BY adjusted_rand DESC, jaccard_t, hamming_t LIMIT 1),
{labels('jl', 'jaccard', 'jaccard_t')}, {labels('hl', 'hamming', 'hamming_t')}, {_RANKED.format(n='jl')}, {_RANKED.format(n='hl')},
ov AS (SELECT idx, size, tokens, jlf.family AS l, hlf.family AS r, jlf.groups AS lg, hlf.groups AS rg FROM gr JOIN jl_l x USING (idx) JOIN hl_l y USING (idx) JOIN jlf ON jlf.label = x.label JOIN hlf ON hlf.label = y.label),
ce AS (SELECT l, r, lg, rg, count(*) AS overlap, CAST(sum(size) AS BIGINT) AS entities FROM ov GROUP BY ALL),
cm AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY overlap DESC, entities DESC, r) = 1 AND row_number() OVER (PARTITION BY r ORDER BY overlap DESC, entities DESC, l) = 1 AS mutual_best,
  row_number() OVER (ORDER BY overlap DESC, entities DESC, l, r) AS rank FROM ce),
ot AS (SELECT l, r, token, row_number() OVER (PARTITION BY l, r ORDER BY sum(size) DESC, count(*) DESC, token) AS k FROM (SELECT l, r, size, unnest(tokens) AS token FROM ov) GROUP BY 1, 2, 3)
SELECT CAST(rank AS INT) AS rank, l AS left_family, r AS right_family, overlap, entities, round(overlap / lg, 6) AS share_of_left, round(overlap / rg, 6) AS share_of_right, round(overlap / (lg + rg - overlap), 6) AS overlap_jaccard, mutual_best,
  coalesce((SELECT string_agg(token, ',' ORDER BY k) FROM ot WHERE ot.l = cm.l AND ot.r = cm.r AND k <= 5), '') AS top_tokens FROM cm WHERE rank <= 8"""


_DAYS = f"""e AS (SELECT * FROM (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15'), (2002, DATE '2002-03-31')) v(y, sunday)),
alld AS (SELECT CAST(x AS DATE) AS d, dayofweek(x) AS w, month(x) AS m, day(x) AS dd FROM (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS x)),
hd AS (
  SELECT d FROM alld WHERE (m = 1 AND ((dd = 1 AND w NOT IN (0, 6)) OR (dd = 2 AND w = 1))) OR (m = 7 AND ((dd = 4 AND w NOT IN (0, 6)) OR (dd = 3 AND w = 5) OR (dd = 5 AND w = 1))) OR (m = 12 AND ((dd = 25 AND w NOT IN (0, 6)) OR (dd = 24 AND w = 5) OR (dd = 26 AND w = 1)))
    OR (w = 1 AND ((m IN (1, 2) AND dd BETWEEN 15 AND 21) OR (m = 5 AND dd >= 25) OR (m = 9 AND dd <= 7))) OR (w = 4 AND m = 11 AND dd BETWEEN 22 AND 28)
  UNION SELECT CAST(sunday - 2 AS DATE) FROM e),
cal AS (SELECT d AS session, row_number() OVER (ORDER BY d) - 1 AS ordinal, (m = 7 AND dd = 3) OR (m = 12 AND dd = 24) OR (m = 11 AND w = 5 AND dd BETWEEN 23 AND 29) AS early_close,
    d >= (SELECT min(x.d) FROM alld x WHERE year(x.d) = year(alld.d) AND x.m = 4 AND x.w = 0) AND d < (SELECT max(x.d) FROM alld x WHERE year(x.d) = year(alld.d) AND x.m = 10 AND x.w = 0) AS summer
  FROM alld WHERE w NOT IN (0, 6) AND d NOT IN (SELECT d FROM hd))"""

SQL = {
    "matched_families": _matched_sql(),
    "family_samples": f"""{tq._PAIRS}, {tq._families('fam', '0.8')}
SELECT label, entity, CAST(row_number() OVER (PARTITION BY label ORDER BY md5('sample:' || entity)) AS INT) AS place FROM vectors JOIN gr USING (vec) JOIN fam USING (idx) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('sample:' || entity)) <= 12""",
    "provider_symbols": """WITH r AS (SELECT p_partkey AS k, p_size, p_brand, chr(CAST(65 + p_partkey % 26 AS INT)) || chr(CAST(65 + (p_partkey // 26) % 26 AS INT)) || 'X' AS base, chr(CAST(65 + p_partkey % 5 AS INT)) AS c FROM part),
cat AS (SELECT k AS listing, CASE WHEN k % 3 = 0 THEN base || '.' || c WHEN k % 11 = 1 THEN lower(base) ELSE base END AS symbol, CASE p_size % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'OTC' END AS exchange,
  CASE WHEN p_brand LIKE '%5' THEN 'etf' ELSE 'stock' END AS kind FROM r WHERE k % 7 <> 0),
asked AS (SELECT DISTINCT upper(trim(CASE k % 4 WHEN 0 THEN base WHEN 1 THEN base || c WHEN 2 THEN ' ' || lower(base) || '-' || lower(c) ELSE base || 'Q' END)) AS ticker FROM r),
tried AS (SELECT ticker, 0 AS step, ticker AS candidate FROM asked
  UNION ALL SELECT ticker, 1, replace(ticker, '-', '.') FROM asked WHERE regexp_full_match(ticker, '[A-Z]{1,4}-[A-Z]')
  UNION ALL SELECT ticker, 1, ticker[:-2] || '.' || ticker[-1:] FROM asked WHERE regexp_full_match(ticker, '[A-Z]{2,4}[ABC]')),
met AS (SELECT t.*, symbol, exchange, row_number() OVER (PARTITION BY ticker ORDER BY symbol IS NULL, step, kind <> 'stock', coalesce(exchange, '') NOT IN ('NYSE', 'NASDAQ', 'AMEX'), listing) AS o FROM tried t LEFT JOIN cat ON upper(symbol) = candidate)
SELECT ticker, max(symbol) FILTER (o = 1) AS provider_symbol, max(exchange) FILTER (o = 1) AS exchange, CASE WHEN count(symbol) > 0 THEN 'verified' ELSE 'unresolved' END AS status,
  CASE WHEN max(step) FILTER (o = 1 AND symbol IS NOT NULL) > 0 THEN 'auto_compact_share_class_fallback' ELSE 'auto' END AS source, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol), '') AS candidates FROM met GROUP BY ticker""",
    "session_calendar": f"""WITH {_DAYS}, od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
p AS (SELECT * FROM od ASOF JOIN cal ON od.day >= cal.session)
SELECT day, session, ordinal, (SELECT arg_max(ordinal, day) FROM p) - ordinal AS to_last, early_close, session || CASE WHEN summer THEN ' 13:30' ELSE ' 14:30' END AS opens_at,
  session || CASE WHEN early_close THEN CASE WHEN summer THEN ' 17:00' ELSE ' 18:00' END WHEN summer THEN ' 20:00' ELSE ' 21:00' END AS closes_at FROM p""",
    "session_returns": f"""WITH {sql.BARS.strip()}, {_DAYS}, dates(as_of) AS (VALUES {', '.join(f"(DATE '{d}')" for d in sq.QUARTERS)}),
base AS (SELECT ticker, as_of, ordinal, session FROM (SELECT DISTINCT ticker FROM bars), (SELECT * FROM dates ASOF JOIN cal ON dates.as_of >= cal.session))
SELECT b.as_of, b.ticker, s.n AS sessions, b.session AS base_date, c.session AS end_date, round(y.close / x.close - 1, 6) AS forward_return
FROM base b CROSS JOIN (VALUES (5), (21), (63)) s(n) JOIN cal c ON c.ordinal = b.ordinal + s.n JOIN bars x ON x.ticker = b.ticker AND x.price_date = b.session AND x.close > 0 JOIN bars y ON y.ticker = b.ticker AND y.price_date = c.session AND y.close > 0""",
}


def _tree_sql() -> str:
    """The tree put together from the definitions as rows, with companies counted in the features."""
    features = ", ".join(f"('{d.factor}', '{d.axis}', '{d.feature_key}', '{d.metric_key}')" for d in default_features())
    states = ", ".join(f"('{s.factor}', '{s.axis}', '{s.signal_key}', {s.priority})" for s in default_signals().signals)
    labels = ", ".join(f"('{k}', '{v}')" for k, v in LABELS.items())
    return f"""WITH {sq._FEATURES}, fd(factor, axis, feature_key, metric_key) AS (VALUES {features}), sd(factor, axis, signal_key, priority) AS (VALUES {states}), lb(k, v) AS (VALUES {labels}),
n AS (SELECT factor, axis, feature_key, metric_key, count(DISTINCT cik) AS companies FROM features GROUP BY ALL),
m AS (SELECT factor, axis, feature_key, list(struct_pack(metric_key := metric_key, companies := coalesce(companies, 0)) ORDER BY metric_key) AS metrics FROM fd LEFT JOIN n USING (factor, axis, feature_key, metric_key) GROUP BY ALL),
f AS (SELECT factor, axis, list(struct_pack(feature_key := feature_key, label := coalesce((SELECT v FROM lb WHERE k = factor || '.' || feature_key), feature_key), metrics := metrics) ORDER BY feature_key) AS features FROM m GROUP BY ALL),
s AS (SELECT factor, axis, list(struct_pack(signal_key := signal_key, label := coalesce((SELECT v FROM lb WHERE k = factor || '.' || signal_key), signal_key), priority := priority) ORDER BY priority, signal_key) AS signals FROM sd GROUP BY ALL),
a AS (SELECT factor, list(struct_pack(axis := axis, features := coalesce(features, []), signals := coalesce(signals, [])) ORDER BY axis) AS axes FROM f FULL JOIN s USING (factor, axis) GROUP BY factor)
SELECT factor, coalesce((SELECT v FROM lb WHERE k = factor), factor) AS label, to_json(axes)::VARCHAR AS axes FROM a"""


SQL["registry_tree"] = _tree_sql()
SQL["feature_shifts"] = f"""WITH {sq._FEATURES}, {sq._LATEST.format(where='')}, {sql.COMPANIES.strip()},
p AS (SELECT factor, axis, feature_key, quantile_cont(feature_value, 0.5) FILTER (sector = 'ASIA') AS inside, count(feature_value) FILTER (sector = 'ASIA') AS n, quantile_cont(feature_value, 0.5) FILTER (sector <> 'ASIA') AS outside,
  quantile_cont(feature_value, 0.25) FILTER (sector <> 'ASIA') AS q1, quantile_cont(feature_value, 0.75) FILTER (sector <> 'ASIA') AS q3 FROM latest JOIN companies USING (cik) GROUP BY 1, 2, 3)
SELECT factor, axis, feature_key, round(inside, 6) AS inside, n, round(outside, 6) AS outside, round(q1, 6) AS q1, round(q3, 6) AS q3, round((inside - outside) / (q3 - q1), 6) AS shift FROM p WHERE n >= 5 AND q3 > q1 ORDER BY abs((inside - outside) / (q3 - q1)) DESC, factor, axis, feature_key LIMIT 5"""
SQL["covered_quarters"] = f"""{tq._AT}, c AS (SELECT as_of, factor, axis, count(DISTINCT entity) AS n, count(DISTINCT signal_key) FILTER (signal_key NOT LIKE 'mixed%') AS k FROM at_ GROUP BY 1, 2, 3),
l AS (SELECT factor, axis, arg_max(n, as_of) AS latest FROM c GROUP BY 1, 2)
SELECT as_of, count(*) AS axes FROM c JOIN l USING (factor, axis) WHERE n >= latest * 0.5 AND k > 0 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM l)"""
SQL["bucket_medians"] = f"""WITH {sq._FEATURES}, {sq._LATEST.format(where='')}, {sq._AGG}, {sq._rules_sql()}, {sq._CHOSEN}
SELECT c.entity, c.factor, c.axis, round(median(a.value), 6) AS bucket_value FROM chosen c LEFT JOIN agg a ON a.entity = c.entity AND a.factor = c.factor AND a.axis = c.axis AND a.feature_key IN {BUCKET} GROUP BY 1, 2, 3"""
SQL["facts_by_parameter"] = f"""WITH {fiscal_queries._STATED} SELECT cik, tag, start, "end", round(val, 4) AS val, form, filed, accn FROM rw WHERE tag IN ('Revenues', 'Parts') AND form IN ('10-K', '8-K') AND val IS NOT NULL AND "end" IS NOT NULL"""
SQL["stale_profiles"] = """WITH t AS (SELECT l_suppkey AS s, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1),
u AS (SELECT 'S' || s AS ticker, s % 7 = 0 OR s % 5 = 0 AS missing, least(CASE WHEN s % 7 = 0 THEN DATE '1970-01-01' ELSE d - CAST(s % 40 AS INT) END, CASE WHEN s % 5 = 0 OR s % 13 = 0 THEN DATE '1970-01-01' ELSE d - CAST(s % 23 AS INT) END) AS oldest_fetch FROM t WHERE s % 11 <> 0)
SELECT * FROM u WHERE missing OR oldest_fetch < DATE '2001-10-20'"""
