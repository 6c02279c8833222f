"""Features, valuation, signals and policies: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import enrichment, evidence, features, relational, serving, signals, valuation
from tidemark.operators import rules as stored_rules
from tidemark.plans import series_queries, sql
from tidemark.plans.common import rounded, stored
from tidemark.plans.registry import AXIS, default_features, default_signals, graded_signals
from tidemark.session import if_small
from tidemark.sources import adapters

YEARS = ["1998-12-31", "1999-12-31", "2000-12-31", "2001-12-31"]
QUARTERS = [f"{y}-{day}" for y in range(1995, 2003) for day in ("03-31", "06-30", "09-30", "12-31")]


def _enriched_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = enrichment.enrich_flow(adapters.flow_series(spark, sf_dir))
    return flows.unionByName(enrichment.enrich_instant(adapters.instant_series(spark, sf_dir)), allowMissingColumns=True)


def _build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_macro(_enriched_all(spark, sf_dir), adapters.macro(spark, sf_dir), ["rate"])
    return features.emit(rows, default_features())


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, as stored by the step before."""
    return stored(spark, sf_dir, "features", lambda: _build_features(spark, sf_dir))


def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_build_features(spark, sf_dir))


def latest_feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As known at the end of 2000: the latest value of each feature."""
    told = features.latest_features(_features(spark, sf_dir), "2000-12-31")
    return rounded(told.select("entity", "factor", "axis", "metric_key", "feature_key", "feature_value", "period_end", "effective_date"))


def sign_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.sign_profiles(adapters.flow_series(spark, sf_dir)))


def sign_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = adapters.flow_series(spark, sf_dir)
    rows = series.select("cik", "metric_key", "end", F.col("val").alias("feature_value"))
    return rounded(features.normalize_sign(rows, features.sign_profiles(series)))


def macro_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = features.macro_contrast(_features(spark, sf_dir), adapters.macro(spark, sf_dir), ["rate", "spread"])
    return rounded(told.select("entity", "metric_key", "feature_key", "period_end", "series_id", "feature_value", "macro_value", "contrast"))


#: Which of the observed series stands for a macro series that metrics are held against; one is never observed.
MACRO_NAMES = {"nominal_gdp_yoy": "rate", "real_gdp_yoy": "spread", "corporate_profits_yoy": "vix", "private_investment_yoy": "spread", "pce_inflation_yoy": "rate"}


def metric_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every latest feature beside the macro series that its metric is mapped to."""
    names = F.create_map(*[F.lit(x) for x in MACRO_NAMES.items() for x in x])
    pairs = F.explode(F.map_entries(names)).alias("e")
    seen = adapters.macro(spark, sf_dir).select("*", pairs).where("e.value = series_id").select(F.col("e.key").alias("series_id"), "observation_date", "value")
    told = features.mapped_macros(_features(spark, sf_dir), seen)
    return rounded(told.select("entity", "factor", "metric_key", "feature_key", "period_end", "place", "series_id", "feature_value", "macro_value", "contrast"))


def _snapshots(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(array(" + ", ".join(f"date'{d}'" for d in YEARS) + ")) as as_of")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's last bar at or before each snapshot."""
    bars = adapters.bars(spark, sf_dir).select(F.col("ticker").alias("listed"), "price_date", "close")
    latest = relational.bitemporal_latest(bars, _snapshots(spark), ["listed"], "price_date", "price_date")
    named = adapters.companies(spark, sf_dir).select("cik", "ticker", "listed")
    return named.join(if_small(latest), "listed").select("cik", "ticker", "as_of", "price_date", "close")


def valuation_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = valuation.known_inputs(_enriched_all(spark, sf_dir), _snapshots(spark))
    return rounded(valuation.composites(inputs, _prices(spark, sf_dir)), metric_value=4)


def implied_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = valuation.known_inputs(_enriched_all(spark, sf_dir), _snapshots(spark))
    return rounded(valuation.expectations(inputs, _prices(spark, sf_dir)), 4)


def factor_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen state of every company and question, with its value, confidence and number of evidence items."""
    told = signals.build(_features(spark, sf_dir), default_signals())
    shown = told.withColumn("evidence", F.concat_ws(",", F.transform("supporting", lambda e: F.concat_ws(":", e["feature_key"], e["metric_key"])))).withColumn("n_contradicting", F.size("contradicting"))
    return rounded(shown.select("entity", "factor", "axis", "signal_key", "signal_value", "confidence", "observed_metrics", "total_metrics", "primary_feature_key", "period_end", "effective_date", "evidence", "n_contradicting"))


def signal_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state from year to year."""
    told = signals.timeline(_features(spark, sf_dir), default_signals(), YEARS, changed_only=True)
    return told.select("entity", "factor", "axis", "as_of", "signal_key")


def quarterly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state over 32 quarter ends, from one reading of the features."""
    told = signals.timeline(_features(spark, sf_dir), default_signals(), QUARTERS, changed_only=True)
    return told.select("entity", "factor", "axis", "as_of", "signal_key")


def graded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every company and question by 114 stored rules, read from a table of JSON."""
    rules = stored_rules.read(stored_rules.store(spark, graded_signals().signals))
    told = signals.build(_features(spark, sf_dir), rules)
    return rounded(told.select("entity", "factor", "axis", "signal_key", "signal_value", "confidence", "primary_feature_key", F.size("supporting").alias("n_supporting")))


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence item of every signal, after it was stored as JSON and read back."""
    rows, _ = evidence.read(evidence.stored(signals.build(_features(spark, sf_dir), default_signals())))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("items")) for side in evidence.SIDES])
    flat = rows.select("entity", "factor", "axis", "signal_key", F.explode(sides).alias("s")).select("entity", "factor", "axis", "signal_key", "s.side", F.posexplode("s.items").alias("place", "i"))
    return rounded(flat.select("entity", "factor", "axis", "signal_key", "side", "place", "i.*"))


def ticker_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of every company, from tables bucketed by company; nested parts as text."""
    told, _ = evidence.read(evidence.stored(signals.build(_features(spark, sf_dir), default_signals())))
    profiles = adapters.companies(spark, sf_dir).drop("listed")
    tables = serving.ServingTables(spark).write(profiles=profiles, features=_features(spark, sf_dir), signals=told)
    rows = serving.overview(*(tables.table(n) for n in ("profiles", "features", "signals")))
    number = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("-"))
    shown = F.transform("features", lambda f: F.concat_ws(":", f["metric_key"], f["feature_key"], number(f["feature_value"]), f["period_end"].cast("string")))
    stated = F.transform("signals", lambda s: F.concat_ws(":", s["factor"], s["signal_key"], number(s["signal_value"]), F.concat_ws("+", F.transform(s["supporting"], lambda e: e["feature_key"]))))
    return rows.select("cik", "ticker", "company_name", "sector", "industry", F.concat_ws(",", shown).alias("features"), F.concat_ws(",", stated).alias("signals"))


def signal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = adapters.companies(spark, sf_dir).count()
    return rounded(signals.validation(_features(spark, sf_dir), default_signals(), size))


def question_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = adapters.companies(spark, sf_dir).count()
    told = signals.validation(_features(spark, sf_dir), default_signals(), size)
    return rounded(signals.question_policies(signals.question_states(told, size)))


QUERIES = {f.__name__: f for f in (
    series_features, latest_feature_values, sign_profiles, sign_normalized, macro_contrasts, metric_macros, valuation_composites, implied_expectations,
    factor_signals, signal_timeline, quarterly_signals, graded_states, evidence_items, ticker_overviews, signal_validation, question_policies,
)}

_INSTANT_ENRICHED = """ie AS (
  SELECT cik, ticker, metric_key, period_type, "end", effective_date, val FROM instant)"""
_BASE = f"""{series_queries.ENRICHED.replace(sql.FLOW, sql.BOTH)}, {sql.MACRO.strip()}, {_INSTANT_ENRICHED}"""


def _feature_sql() -> str:
    """Each default feature as a query over the enriched rows."""
    parts = []
    for d in default_features():
        s, w = d.source, "OVER (PARTITION BY cik, metric_key ORDER BY \"end\""
        frame = f"{w} ROWS BETWEEN {d.lookback - 1} PRECEDING AND CURRENT ROW)"
        full = f"count(*) {frame} = {d.lookback}"
        source = f"(SELECT * FROM enriched WHERE metric_key = '{d.metric_key}') e"
        asof = lambda metric, alias: f" ASOF LEFT JOIN (SELECT cik, \"end\", {{}} AS v FROM {'ie' if metric == 'assets' else 'enriched'} WHERE metric_key = '{metric}') {alias} ON e.cik = {alias}.cik AND e.\"end\" >= {alias}.\"end\""
        if d.method in ("direct", "negative_direct"):
            v = f"0 - {s}" if d.method[0] == "n" else s
        elif d.method in ("positive_ratio", "negative_ratio"):
            op = ">" if d.method[0] == "p" else "<"
            v = f"CASE WHEN {full} AND count({s}) {frame} > 0 THEN CAST(sum(CASE WHEN {s} {op} 0 THEN 1 ELSE 0 END) {frame} AS DOUBLE) / count({s}) {frame} END"
        elif d.method == "valid_ratio":
            v = f"CASE WHEN {full} THEN CAST(count({s}) {frame} AS DOUBLE) / {d.lookback} END"
        elif d.method == "ratio_to_denominator":
            source += asof(d.denominator, "d").format(d.denominator_source)
            v = f"CASE WHEN d.v <> 0 THEN {s} / abs(d.v) END"
        elif d.method == "spread_to_denominator":
            source += asof(d.counterpart, "c").format(d.counterpart_source) + asof(d.denominator, "d").format(d.denominator_source)
            v = f"CASE WHEN d.v <> 0 THEN ({s} - c.v) / abs(d.v) END"
        elif d.method == "ratio_deviation":
            v = f"CASE WHEN {d.reference} <> 0 THEN {s} / {d.reference} - 1 END"
        elif d.method == "lag_ratio_deviation":
            v = f"CASE WHEN lag({s}, {d.lag}) {w}) <> 0 THEN {s} / lag({s}, {d.lag}) {w}) - 1 END"
        elif d.method in ("relative_deviation", "negative_relative_deviation"):
            v = f"{'0 - ' if d.method[0] == 'n' else ''}(CASE WHEN {d.reference} <> 0 THEN ({s} - {d.reference}) / abs({d.reference}) END)"
        elif d.method == "turnaround_momentum":
            v = "CASE WHEN is_turnaround THEN 1.0 WHEN is_loss_narrowing THEN 0.5 WHEN is_deterioration THEN -1.0 WHEN coalesce(is_turnaround, is_loss_narrowing, is_deterioration) IS NOT NULL THEN 0.0 END"
        else:
            source = f"(SELECT e.*, m.value * {d.macro_scale} AS mv FROM enriched e ASOF LEFT JOIN (SELECT * FROM macro WHERE value IS NOT NULL AND series_id = '{d.macro_series}') m ON e.\"end\" >= m.observation_date WHERE metric_key = '{d.metric_key}') e"
            twenty = f"{w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
            both = f"{s} IS NOT NULL AND mv IS NOT NULL"
            x, y = f"CASE WHEN {both} THEN mv END", f"CASE WHEN {both} THEN {s} END"
            v = f"CASE WHEN count(CASE WHEN {both} THEN 1 END) {twenty} >= 12 AND var_samp({x}) {twenty} > 0 THEN covar_samp({y}, {x}) {twenty} / var_samp({x}) {twenty} END"
        cols = v if " d.v" in source or "ASOF LEFT JOIN (SELECT cik" in source else v
        parts.append(f"SELECT e.ticker, e.cik, '{d.factor}' AS factor, '{d.axis}' AS axis, e.metric_key, '{d.feature_key}' AS feature_key, CAST({_qualify(cols, source)} AS DOUBLE) AS feature_value, e.\"end\" AS period_end, e.effective_date FROM {source}")
    return "features AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE feature_value IS NOT NULL)"


def _qualify(v: str, source: str) -> str:
    if "ASOF LEFT JOIN (SELECT cik" not in source:
        return v
    return v.replace("ttm_val", "e.ttm_val")


_FEATURES = f"{_BASE}, {_feature_sql()}"
_LATEST = """latest AS (
  SELECT cik AS entity, * FROM features {where}
  QUALIFY row_number() OVER (PARTITION BY cik, factor, axis, metric_key, feature_key ORDER BY effective_date DESC, period_end DESC) = 1)"""
_AGG = """agg AS (SELECT entity, factor, axis, feature_key, median(feature_value) AS value, count(DISTINCT metric_key) AS metrics FROM latest GROUP BY 1, 2, 3, 4),
scope AS (SELECT entity, factor, axis, count(DISTINCT metric_key) AS total_metrics, max(effective_date) AS effective_date, arg_max(period_end, (effective_date, period_end)) AS period_end FROM latest GROUP BY 1, 2, 3)"""


def _rules_sql(empty: bool = True) -> str:
    """One row per entity and definition that matches: (entity, factor, axis, signal_key, priority, primary feature)."""
    parts = []
    for (factor, axis), defs in default_signals().scopes().items():
        for d in defs:
            has = lambda c: f"EXISTS (SELECT 1 FROM agg a WHERE a.entity = s.entity AND a.factor = s.factor AND a.axis = s.axis AND a.feature_key = '{c.feature_key}' AND a.metrics >= {c.least_metrics} AND a.value {c.operator} {c.value})"
            test = " AND ".join([has(c) for c in d.all] + (["(" + " OR ".join(has(c) for c in d.any) + ")"] if d.any else [])) or "true"
            key = (d.any or d.all)[0].feature_key if d.conditions else d.supporting[0]
            parts.append(f"SELECT entity, factor, axis, '{d.signal_key}' AS signal_key, {d.priority} AS priority, '{key}' AS key, {len(d.contradicting)} AS contra FROM scope s WHERE factor = '{factor}' AND axis = '{axis}' AND {test}")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def _evidence_sql() -> str:
    rows = ", ".join(f"('{d.factor}', '{d.signal_key}', '{k}', {i})" for d in default_signals().signals for i, k in enumerate(d.supporting))
    contra = ", ".join(f"('{d.factor}', '{d.signal_key}', '{k}')" for d in default_signals().signals for k in d.contradicting)
    return f"""
sup(factor, signal_key, feature_key, pos) AS (VALUES {rows}), con(factor, signal_key, feature_key) AS (VALUES {contra}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, factor, axis, feature_key ORDER BY abs(feature_value) DESC, metric_key) AS i FROM latest),
items AS (SELECT c.entity, c.factor, r.feature_key, r.metric_key, r.feature_value, row_number() OVER (PARTITION BY c.entity, c.factor ORDER BY r.i, s.pos) AS o
  FROM chosen c JOIN sup s ON s.factor = c.factor AND s.signal_key = c.signal_key JOIN ranked r ON r.entity = c.entity AND r.factor = c.factor AND r.feature_key = s.feature_key),
ev AS (SELECT entity, factor, string_agg(feature_key || ':' || metric_key, ',' ORDER BY o) AS evidence, arg_min(feature_key, o) AS first_key FROM items WHERE o <= 5 GROUP BY 1, 2),
nc AS (SELECT c.entity, c.factor, count(r.feature_key) AS n FROM chosen c LEFT JOIN con k ON k.factor = c.factor AND k.signal_key = c.signal_key LEFT JOIN ranked r ON r.entity = c.entity AND r.factor = c.factor AND r.feature_key = k.feature_key GROUP BY 1, 2)"""


_CHOSEN = "chosen AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY entity, factor, axis ORDER BY priority, signal_key) = 1)"
_VALID = f"""WITH {_FEATURES}, {_LATEST.format(where='')}, {_AGG}, {_rules_sql()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, factor, axis ORDER BY priority, signal_key) AS r FROM hits),
defs(factor, axis, signal_key, priority, driver) AS (VALUES {', '.join(f"('{s.factor}', '{s.axis}', '{s.signal_key}', {s.priority}, {repr(s.conditions[0].feature_key) if s.conditions else 'NULL'})" for s in default_signals().signals)}),
conds(factor, signal_key, feature_key, t) AS (VALUES {', '.join(f"('{s.factor}', '{s.signal_key}', '{c.feature_key}', {c.value})" for s in default_signals().signals for c in s.conditions)}),
dist AS (SELECT a.entity, c.factor, c.signal_key, min(abs(a.value - c.t) / greatest(abs(c.t), 1.0)) AS d FROM conds c JOIN agg a ON a.factor = c.factor AND a.feature_key = c.feature_key GROUP BY 1, 2, 3),
told AS (
  SELECT d.factor, d.axis, d.signal_key, d.priority, count(*) FILTER (r.r = 1) AS n, count(*) FILTER (r.r > 1) AS shadowed,
    quantile_cont(a.value, 0.1) FILTER (r.r = 1) AS driver_p10, quantile_cont(a.value, 0.5) FILTER (r.r = 1) AS driver_p50, quantile_cont(a.value, 0.9) FILTER (r.r = 1) AS driver_p90, min(x.d) FILTER (r.r = 1) AS nearest_threshold
  FROM defs d LEFT JOIN ranked r ON r.factor = d.factor AND r.axis = d.axis AND r.signal_key = d.signal_key
  LEFT JOIN agg a ON a.entity = r.entity AND a.factor = r.factor AND a.feature_key = d.driver LEFT JOIN dist x ON x.entity = r.entity AND x.factor = r.factor AND x.signal_key = r.signal_key
  GROUP BY 1, 2, 3, 4)"""

_CLOSES = f"""{sql.COMPANIES.strip()}, {sql.BARS.strip()},
snaps(as_of) AS (VALUES {', '.join(f"(DATE '{d}')" for d in YEARS)}),
pr AS (SELECT c.cik, c.ticker, s.as_of, b.price_date, b.close FROM companies c CROSS JOIN snaps s ASOF JOIN bars b ON c.listed = b.ticker AND s.as_of >= b.price_date),
rows_ AS (SELECT cik, metric_key, 'quarter' AS pt, "end", effective_date, ttm_val AS v, ttm_yoy AS g FROM enriched UNION ALL SELECT cik, metric_key, 'instant', "end", effective_date, val, NULL FROM ie),
k AS (SELECT r.*, s.as_of FROM rows_ r JOIN snaps s ON r.effective_date <= s.as_of QUALIFY row_number() OVER (PARTITION BY cik, metric_key, s.as_of ORDER BY effective_date DESC, "end" DESC) = 1),
i AS (
  SELECT cik, as_of, {', '.join(f"max(v) FILTER (metric_key = '{m}') AS {m}, max(effective_date) FILTER (metric_key = '{m}') AS {m}_k, max(\"end\") FILTER (metric_key = '{m}') AS {m}_e" for m in [*adapters.FLOWS, *adapters.INSTANTS])},
    max(g) FILTER (metric_key = 'eps_diluted') AS gd, max(g) FILTER (metric_key = 'eps_basic') AS gb
  FROM k GROUP BY 1, 2),
j AS (SELECT i.*, pr.* EXCLUDE (cik, as_of), CASE WHEN shares_outstanding > 0 THEN close * shares_outstanding END AS cap FROM i JOIN pr USING (cik, as_of) WHERE close > 0),
vv AS (SELECT *, cap + short_term_debt + long_term_debt - cash_and_cash_equivalents AS ev, CASE WHEN cap > 0 THEN dividend_payments / cap END AS dy, CASE WHEN cap > 0 THEN share_repurchases / cap END AS bb FROM j)"""


def _composite_sql() -> str:
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"
    sh = "CASE WHEN dy IS NOT NULL OR bb IS NOT NULL THEN coalesce(dy, 0) + coalesce(bb, 0) END"
    shk = "greatest(price_date, shares_outstanding_k, {})"
    both_e, both_k = "greatest(dividend_payments_e, share_repurchases_e)", shk.format("dividend_payments_k, share_repurchases_k")
    rows = [
        ("market_capitalization", "cap", "shares_outstanding_e", "greatest(price_date, shares_outstanding_k)"), ("log_market_capitalization", "CASE WHEN cap > 0 THEN ln(cap) END", "shares_outstanding_e", "greatest(price_date, shares_outstanding_k)"),
        ("price_to_diluted_ttm_eps", r("close", "eps_diluted"), "eps_diluted_e", "greatest(price_date, eps_diluted_k)"), ("price_to_basic_ttm_eps", r("close", "eps_basic"), "eps_basic_e", "greatest(price_date, eps_basic_k)"),
        ("diluted_ttm_eps_growth", "gd", "eps_diluted_e", "coalesce(eps_diluted_k, price_date)"), ("basic_ttm_eps_growth", "gb", "eps_basic_e", "coalesce(eps_basic_k, price_date)"),
        ("price_to_book", r("cap", "stockholders_equity"), "stockholders_equity_e", shk.format("stockholders_equity_k")), ("price_to_sales", r("cap", "revenue"), "revenue_e", shk.format("revenue_k")),
        ("price_to_earnings", r("cap", "net_income"), "net_income_e", shk.format("net_income_k")), ("price_to_operating_cash_flow", r("cap", "operating_cash_flow"), "operating_cash_flow_e", shk.format("operating_cash_flow_k")),
        ("free_cash_flow_yield", r("operating_cash_flow - capex_cash", "cap"), "greatest(operating_cash_flow_e, capex_cash_e)", shk.format("operating_cash_flow_k, capex_cash_k")),
        ("enterprise_value_to_sales", r("ev", "revenue"), "greatest(shares_outstanding_e, short_term_debt_e, long_term_debt_e, cash_and_cash_equivalents_e, revenue_e)", shk.format("short_term_debt_k, long_term_debt_k, cash_and_cash_equivalents_k, revenue_k")),
        ("dividend_yield", "dy", "dividend_payments_e", shk.format("dividend_payments_k")), ("buyback_yield", "bb", "share_repurchases_e", shk.format("share_repurchases_k")),
        ("shareholder_yield", sh, both_e, both_k), ("dividend_yield_share", r("dy", sh), both_e, both_k), ("buyback_yield_share", r("bb", sh), both_e, both_k),
    ]
    return " UNION ALL ".join(f"SELECT cik, ticker, as_of, '{k}' AS metric_key, round({x}, 4) AS metric_value, coalesce({e}, price_date) AS period_end, {d} AS effective_date FROM vv WHERE ({x}) IS NOT NULL" for k, x, e, d in rows)


SQL = {
    "series_features": f"WITH {_FEATURES} SELECT * REPLACE (round(feature_value, 6) AS feature_value) FROM features",
    "latest_feature_values": f"WITH {_FEATURES}, {_LATEST.format(where=chr(87) + 'HERE effective_date <= DATE ' + chr(39) + '2000-12-31' + chr(39))} SELECT entity, factor, axis, metric_key, feature_key, round(feature_value, 6) AS feature_value, period_end, effective_date FROM latest",
    "sign_profiles": f"""WITH {sql.FLOW}, t AS (SELECT cik, metric_key, count(*) AS n, avg((val > 0)::INT) AS positive_share, avg((val < 0)::INT) AS negative_share, avg((val = 0)::INT) AS zero_share FROM flow GROUP BY 1, 2)
SELECT cik, metric_key, n, round(positive_share, 6) AS positive_share, round(negative_share, 6) AS negative_share, round(zero_share, 6) AS zero_share,
  CASE WHEN n >= 5 AND positive_share >= 0.9 THEN 'positive' WHEN n >= 5 AND negative_share >= 0.9 THEN 'negative' ELSE 'mixed' END AS kind,
  round(greatest(positive_share, negative_share) * least(n / 20, 1.0), 4) AS confidence FROM t""",
    "sign_normalized": f"""WITH {sql.FLOW}, t AS (SELECT cik, metric_key, count(*) AS n, avg((val > 0)::INT) AS p, avg((val < 0)::INT) AS m FROM flow GROUP BY 1, 2)
SELECT cik, metric_key, "end", round(CASE WHEN p >= 0.9 THEN val ELSE -val END, 6) AS feature_value FROM flow JOIN t USING (cik, metric_key)
WHERE n >= 5 AND (p >= 0.9 OR m >= 0.9) AND round(greatest(p, m) * least(n / 20, 1.0), 4) >= 0.8""",
    "macro_contrasts": f"""WITH {_FEATURES}, {_LATEST.format(where='')},
l AS (SELECT * FROM latest, (VALUES ('rate'), ('spread')) s(series_id))
SELECT entity, metric_key, feature_key, period_end, l.series_id, round(feature_value, 6) AS feature_value, round(m.value, 6) AS macro_value, round(feature_value - m.value / 100, 6) AS contrast
FROM l ASOF JOIN (SELECT * FROM macro WHERE value IS NOT NULL) m ON l.series_id = m.series_id AND l.period_end >= m.observation_date""",
    "metric_macros": f"""WITH {_FEATURES}, {_LATEST.format(where='')},
named(name, series_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in MACRO_NAMES.items())}), seen AS (SELECT name, observation_date, value FROM macro JOIN named USING (series_id) WHERE value IS NOT NULL),
l AS (SELECT *, CASE WHEN metric_key LIKE 'capex%' THEN ['private_investment_yoy', 'nonresidential_fixed_investment_yoy'] WHEN metric_key IN ('net_income', 'operating_cash_flow') THEN ['corporate_profits_yoy', 'nominal_gdp_yoy']
  WHEN metric_key = 'revenue' THEN ['nominal_gdp_yoy', 'real_gdp_yoy', 'pce_inflation_yoy'] ELSE ['nominal_gdp_yoy', 'real_gdp_yoy'] END AS keys FROM latest),
x AS (SELECT *, unnest(keys) AS name, CAST(unnest(range(1, len(keys) + 1)) AS INT) AS place FROM l)
SELECT entity, factor, metric_key, feature_key, period_end, place, x.name AS series_id, round(feature_value, 6) AS feature_value, round(m.value, 6) AS macro_value, round(feature_value - m.value / 100, 6) AS contrast
FROM x ASOF LEFT JOIN seen m ON x.name = m.name AND x.period_end >= m.observation_date""",
    "valuation_composites": f"WITH {_BASE}, {_CLOSES} {_composite_sql()}",
    "implied_expectations": f"""WITH {_BASE}, {_CLOSES},
sets(assumption_set, y, r, s, p, m) AS (VALUES {', '.join(f"('{k}', {y}.0::DOUBLE, {r}::DOUBLE, {s}::DOUBLE, {p}::DOUBLE, {m}::DOUBLE)" for k, y, r, s, p, m in valuation.ASSUMPTIONS)}),
a AS (SELECT vv.*, sets.*, ev * pow(1 + r, y) AS terminal_ev, cap * pow(1 + r, y) AS terminal_equity, ev * pow(1 + r, y) / s AS implied_revenue, cap * pow(1 + r, y) / p AS implied_net_income FROM vv, sets),
c AS (SELECT *, CASE WHEN implied_revenue > 0 AND revenue > 0 THEN pow(implied_revenue / revenue, 1 / y) - 1 END AS revenue_cagr, CASE WHEN implied_net_income > 0 AND net_income > 0 THEN pow(implied_net_income / net_income, 1 / y) - 1 END AS net_income_cagr,
  CASE WHEN shares_outstanding > 0 THEN implied_net_income / shares_outstanding END AS implied_eps, CASE WHEN revenue > 0 THEN ev / revenue END AS ev_to_sales, CASE WHEN net_income > 0 THEN cap / net_income END AS price_to_earnings FROM a),
d AS (SELECT *, CASE WHEN implied_eps > 0 AND eps_diluted > 0 THEN pow(implied_eps / eps_diluted, 1 / y) - 1 END AS eps_cagr,
  greatest(CASE WHEN revenue_cagr IS NOT NULL THEN least(greatest((revenue_cagr - 0.02) / 0.28, 0), 1) END, CASE WHEN net_income_cagr IS NOT NULL THEN least(greatest((net_income_cagr - 0.02) / 0.28, 0), 1) END) AS gb_, least(greatest((m - 0.05) / 0.45, 0), 1) AS mb_,
  CASE WHEN ev_to_sales IS NOT NULL THEN least(greatest(ev_to_sales / s / 2, 0), 1) END AS f1, CASE WHEN price_to_earnings IS NOT NULL THEN least(greatest(price_to_earnings / p / 2, 0), 1) END AS f2 FROM c)
SELECT cik, ticker, as_of, assumption_set, round(cap, 4) AS cap, round(ev, 4) AS ev, round(terminal_ev, 4) AS terminal_ev, round(terminal_equity, 4) AS terminal_equity, round(implied_revenue, 4) AS implied_revenue, round(revenue_cagr, 4) AS revenue_cagr,
  round(implied_revenue * m, 4) AS implied_operating_income, round(implied_net_income, 4) AS implied_net_income, round(net_income_cagr, 4) AS net_income_cagr, round(implied_eps, 4) AS implied_eps, round(eps_cagr, 4) AS eps_cagr, round(ev_to_sales, 4) AS ev_to_sales, round(price_to_earnings, 4) AS price_to_earnings,
  round(CASE WHEN revenue > 0 THEN net_income / revenue END, 4) AS net_margin, round(CASE WHEN gb_ IS NULL THEN mb_ ELSE (gb_ + mb_) / 2 END, 4) AS burden_score, round(CASE WHEN f1 IS NULL THEN f2 WHEN f2 IS NULL THEN f1 ELSE (f1 + f2) / 2 END, 4) AS fragility_score FROM d""",
    "factor_signals": f"""WITH {_FEATURES}, {_LATEST.format(where='')}, {_AGG}, {_rules_sql()}, {_CHOSEN}, {_evidence_sql().strip()}
SELECT c.entity, c.factor, c.axis, c.signal_key, round(a.value, 6) AS signal_value, round(least(1.0, a.metrics / 3), 6) AS confidence, CAST(coalesce(a.metrics, 0) AS INT) AS observed_metrics, CAST(s.total_metrics AS INT) AS total_metrics,
  k.key AS primary_feature_key, s.period_end, s.effective_date, coalesce(ev.evidence, '') AS evidence, CAST(least(nc.n, 5) AS INT) AS n_contradicting
FROM chosen c JOIN scope s USING (entity, factor, axis) LEFT JOIN ev ON ev.entity = c.entity AND ev.factor = c.factor LEFT JOIN nc ON nc.entity = c.entity AND nc.factor = c.factor
LEFT JOIN LATERAL (SELECT CASE WHEN c.signal_key LIKE 'mixed%' THEN ev.first_key ELSE c.key END AS key) k ON true
LEFT JOIN agg a ON a.entity = c.entity AND a.factor = c.factor AND a.feature_key = k.key""",
    "signal_validation": f"""{_VALID} SELECT factor, axis, signal_key, CAST(priority AS INT) AS priority, n, round(n / (SELECT count(*) FROM supplier), 6) AS share, shadowed, round(driver_p10, 6) AS driver_p10, round(driver_p50, 6) AS driver_p50, round(driver_p90, 6) AS driver_p90, round(nearest_threshold, 6) AS nearest_threshold FROM told""",
    "question_policies": f"""{_VALID},
qq AS (SELECT factor, axis, sum(n) AS selected, coalesce(sum(n) FILTER (signal_key LIKE '%mixed%'), 0) AS mixed, max(n) AS dominant, (SELECT count(*) FROM supplier) AS g FROM told GROUP BY 1, 2),
pp AS (SELECT factor, axis, n FROM told WHERE n > 0 UNION ALL SELECT factor, axis, g - selected FROM qq WHERE g > selected),
ee AS (SELECT factor, axis, CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) END AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY factor, axis) AS t FROM pp) GROUP BY 1, 2),
ss AS (SELECT factor, axis, CAST(selected AS BIGINT) AS selected, CAST(mixed AS BIGINT) AS mixed, greatest(g - selected, 0) / g AS ns, (selected - mixed) / g AS ds, dominant / g AS dm, entropy FROM qq JOIN ee USING (factor, axis)),
rr AS (SELECT *, (ns > 0.2)::INT + (dm > 0.6)::INT + (ds < 0.25)::INT + coalesce((entropy < 0.45)::INT, 0) AS reasons FROM ss)
SELECT factor, axis, selected, mixed, round(ns, 6) AS no_signal_share, round(ds, 6) AS directional_share, round(dm, 6) AS dominant_share, round(entropy, 6) AS entropy, reasons,
  CASE WHEN ns > 0.45 OR ds < 0.1 THEN 'hold' WHEN reasons > 1 OR ns > 0.2 OR dm > 0.6 THEN 'review' ELSE 'use' END AS status FROM rr""",
}


def _timeline_sql(dates: list[str]) -> str:
    """Changes between snapshots, each worked out on its own."""
    at = lambda i, d: f"h{i} AS MATERIALIZED (WITH {_LATEST.format(where=f'WHERE effective_date <= DATE {chr(39)}{d}{chr(39)}')}, {_AGG}, {_rules_sql()}, {_CHOSEN} SELECT entity, factor, axis, DATE '{d}' AS as_of, signal_key FROM chosen)"
    return f"WITH {_FEATURES.replace('features AS (', 'features AS MATERIALIZED (')}, " + ", ".join(at(i, d) for i, d in enumerate(dates)) + ", tt AS (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(len(dates))) + """)
SELECT * FROM tt QUALIFY lag(signal_key) OVER (PARTITION BY entity, factor, axis ORDER BY as_of) IS DISTINCT FROM signal_key"""


SQL["signal_timeline"], SQL["quarterly_signals"] = _timeline_sql(YEARS), _timeline_sql(QUARTERS)
SQL["graded_states"] = f"""WITH {_FEATURES}, {_LATEST.format(where='')}, {_AGG},
rules(factor, signal_key, priority, feature_key, t) AS (VALUES {", ".join(f"('{s.factor}', '{s.signal_key}', {s.priority}, '{s.all[0].feature_key}', {s.all[0].value}::DOUBLE)" for s in graded_signals().signals)}),
best AS (SELECT a.*, r.signal_key FROM agg a JOIN rules r ON r.factor = a.factor AND r.feature_key = a.feature_key AND a.value >= r.t QUALIFY row_number() OVER (PARTITION BY entity, a.factor, axis ORDER BY priority, signal_key) = 1)
SELECT entity, factor, axis, signal_key, round(value, 6) AS signal_value, round(least(1.0, metrics / 3), 6) AS confidence, feature_key AS primary_feature_key, CAST(least(metrics, 5) AS INT) AS n_supporting FROM best"""
_ITEMS = f"""placed(factor, signal_key, feature_key, pos) AS (VALUES {", ".join(f"('{d.factor}', '{d.signal_key}', '{k}', {i})" for d in default_signals().signals for i, k in enumerate(d.contradicting))}),
all_items AS (
  SELECT c.entity, c.factor, c.axis, c.signal_key, side, r.metric_key, r.feature_key, r.feature_value, r.period_end, r.effective_date, row_number() OVER (PARTITION BY c.entity, c.factor, side ORDER BY r.i, s.pos) - 1 AS place
  FROM chosen c JOIN (SELECT 'supporting' AS side, * FROM sup UNION ALL SELECT 'contradicting', * FROM placed) s ON s.factor = c.factor AND s.signal_key = c.signal_key
  JOIN ranked r ON r.entity = c.entity AND r.factor = c.factor AND r.feature_key = s.feature_key)"""
_SIGNALS = f"WITH {_FEATURES}, {_LATEST.format(where='')}, {_AGG}, {_rules_sql()}, {_CHOSEN}, {_evidence_sql().strip()}, {_ITEMS}"
SQL["evidence_items"] = f"""{_SIGNALS} SELECT entity, factor, axis, signal_key, side, CAST(place AS INT) AS place, metric_key, feature_key, round(feature_value, 6) AS feature_value, period_end, effective_date FROM all_items WHERE place < 5"""
SQL["ticker_overviews"] = f"""{_SIGNALS}, {sql.COMPANIES.strip()},
fs AS (SELECT cik, string_agg(metric_key || ':' || feature_key || ':' || format('{{:.4f}}', feature_value) || ':' || CAST(period_end AS DATE)::VARCHAR, ',' ORDER BY factor, axis, metric_key, feature_key) AS features FROM latest GROUP BY 1),
ss AS (SELECT c.entity, string_agg(c.factor || ':' || c.signal_key || ':' || coalesce(format('{{:.4f}}', a.value), '-') || ':' || coalesce(i.keys, ''), ',' ORDER BY c.factor) AS signals
  FROM chosen c LEFT JOIN ev ON ev.entity = c.entity AND ev.factor = c.factor
  LEFT JOIN agg a ON a.entity = c.entity AND a.factor = c.factor AND a.feature_key = CASE WHEN c.signal_key LIKE 'mixed%' THEN ev.first_key ELSE c.key END
  LEFT JOIN (SELECT entity, factor, string_agg(feature_key, '+' ORDER BY place) AS keys FROM all_items WHERE side = 'supporting' AND place < 5 GROUP BY 1, 2) i ON i.entity = c.entity AND i.factor = c.factor GROUP BY 1)
SELECT cik, ticker, company_name, sector, industry, coalesce(features, '') AS features, coalesce(signals, '') AS signals FROM companies LEFT JOIN fs USING (cik) LEFT JOIN ss ON ss.entity = cik"""
__all__ = ["AXIS", "QUERIES", "SQL"]
