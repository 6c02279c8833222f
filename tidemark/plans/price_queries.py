"""Price features, proxy betas and macro observations: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import prices, relational
from tidemark.plans import sql
from tidemark.plans.common import rounded
from tidemark.sources import adapters

NAMES = {"SPY": "spy", "ECONOMY": "qqq", "SMALL": "dia"}
CHANGES = {"rate": "rate", "vix": "curve", "spread": "credit"}
RELATIVE = {
    "priceReturn3M": "relativeReturn3M", "priceReturn6M": "relativeReturn6M", "priceReturn12M": "relativeReturn12M",
    "priceMomentum12MEx1M": "relativeMomentum12MEx1M", "maxDrawdown1Y": "drawdownDefense1Y",
}
BASKETS = {"economy": ["ECONOMY"], "small_pair": ["SMALL", "MEDIUM"], "all_types": ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO"]}


def _benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.benchmark_bars(spark, sf_dir).unionByName(adapters.bars(spark, sf_dir, "p_type"))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.market_frame(_benchmarks(spark, sf_dir), adapters.macro(spark, sf_dir), NAMES, CHANGES, {"vix": "vix"})


def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of each brand at its last bar."""
    return rounded(prices.price_features(adapters.bars(spark, sf_dir), _market(spark, sf_dir), others=("qqq", "dia")))


def relative_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point returns and drawdown less the benchmark's own."""
    market = _market(spark, sf_dir)
    own = prices.price_features(adapters.benchmark_bars(spark, sf_dir), market)
    return rounded(prices.relative_features(prices.price_features(adapters.bars(spark, sf_dir), market), own, RELATIVE))


def price_feature_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features as of each year's end, from one pass over the bars."""
    shots = spark.sql("select explode(sequence(date'1998-12-31', date'2001-12-31', interval 1 year)) as as_of")
    told = prices.price_features(adapters.bars(spark, sf_dir), _market(spark, sf_dir), shots)
    return rounded(told)


def proxy_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betas against single proxies and equal-weight baskets over 756 returns."""
    members = spark.createDataFrame([(d, t) for d, ts in BASKETS.items() for t in ts], "definition string, ticker string")
    baskets = prices.basket_returns(prices.daily_log_returns(adapters.bars(spark, sf_dir, "p_type")), members)
    return rounded(prices.proxy_betas(adapters.bars(spark, sf_dir), baskets))


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices.daily_log_returns(adapters.bars(spark, sf_dir)))


def macro_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices.macro_changes(adapters.macro(spark, sf_dir)), 8)


def macro_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest and the previous valid observation of each series and the number of observations."""
    known = adapters.macro(spark, sf_dir)
    counts = known.groupBy("series_id").agg(F.count("*").alias("n_observations"), F.count("value").alias("n_valid"))
    two = relational.latest_by(known.where("value is not null").withColumn("r", F.lit(1)), ["series_id"], [F.desc("observation_date")], 2)
    pair = two.groupBy("series_id").agg(
        F.max("observation_date").alias("latest_date"), F.max_by("value", "observation_date").alias("latest_value"),
        F.min("observation_date").alias("previous_date"), F.min_by("value", "observation_date").alias("previous_value"),
    )
    return rounded(pair.join(F.broadcast(counts), "series_id"), 8)


def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose last bar is within a week of a reference date, without the benchmarks."""
    bars = prices.without(adapters.bars(spark, sf_dir).unionByName(_benchmarks(spark, sf_dir)), ["SPY"])
    fresh = prices.fresh_tickers(bars, F.lit("2001-11-07").cast("date"))
    return fresh.groupBy("ticker").agg(F.count("*").alias("bars"), F.max("price_date").alias("last_bar"))


QUERIES = {f.__name__: f for f in (price_features, relative_price_features, price_feature_timeline, proxy_betas, daily_returns, macro_changes, macro_overview, stale_filter)}


def _features(others: tuple[str, ...] = ()) -> dict[str, str]:
    pick = lambda n: f"max(close) FILTER (rn = {n + 1})"
    ret = lambda n: f"{pick(0)} / {pick(n)} - 1"
    n1, n3 = "rn <= 252", "rn <= 756"

    def slope(x, at, least):
        ok = f"{at} AND r IS NOT NULL AND {x} IS NOT NULL"
        return f"CASE WHEN count(*) FILTER ({ok}) >= {least} AND var_samp({x}) FILTER ({ok}) > 0 THEN covar_samp(r, {x}) FILTER ({ok}) / var_samp({x}) FILTER ({ok}) END"

    def corr(x, at):
        ok = f"{at} AND r IS NOT NULL AND {x} IS NOT NULL"
        return f"CASE WHEN count(*) FILTER ({ok}) >= 30 AND var_samp({x}) FILTER ({ok}) > 0 AND var_samp(r) FILTER ({ok}) > 0 THEN corr(r, {x}) FILTER ({ok}) END"

    def capture(cond):
        ok = f"{n1} AND r IS NOT NULL AND {cond}"
        return f"CASE WHEN count(*) FILTER ({ok}) >= 10 AND sum(spy) FILTER ({ok}) <> 0 THEN sum(r) FILTER ({ok}) / sum(spy) FILTER ({ok}) END"

    def excess(cond, at, least):
        ok = f"{at} AND r IS NOT NULL AND spy IS NOT NULL AND {cond}"
        return f"CASE WHEN count(*) FILTER ({ok}) >= {least} THEN sum(r - spy) FILTER ({ok}) END"

    months = " + ".join(f"(max(close) FILTER (rn = {21 * k + 1}) > max(close) FILTER (rn = {21 * k + 22}))::INT" for k in range(12))
    out = {
        "priceReturn3M": ret(63), "priceReturn6M": ret(126), "priceReturn12M": ret(252), "priceMomentum12MEx1M": f"{pick(21)} / {pick(252)} - 1",
        "momentumConsistency12M": f"({months}) / 12", "distanceFrom52WeekHigh": f"{pick(0)} / max(close) FILTER ({n1}) - 1",
        "realizedVolatility1Y": f"stddev_samp(r) FILTER ({n1}) * sqrt(252)", "realizedVolatility3Y": f"stddev_samp(r) FILTER ({n3}) * sqrt(252)",
        "downsideVolatility1Y": f"CASE WHEN count(*) FILTER ({n1} AND r < 0) >= 10 THEN stddev_samp(r) FILTER ({n1} AND r < 0) * sqrt(252) END",
        "maxDrawdown1Y": f"min(close / peak - 1) FILTER ({n1})",
        "marketBeta1Y": slope("spy", n1, 30), "marketBeta3Y": slope("spy", n3, 30), "correlationToMarket3Y": corr("spy", n3),
        "upsideCapture1Y": capture("spy > 0"), "downsideCapture1Y": capture("spy < 0"), "downsideCaptureDefense1Y": f"1 - ({capture('spy < 0')})",
        "downMarketDefense1Y": excess("spy < 0", n1, 30), "downMarketDefense3Y": excess("spy < 0", n3, 30),
        "volatilityStressDefense1Y": excess("vix >= 25", n1, 10), "volatilityStressDefense3Y": excess("vix >= 25", n3, 10),
        "rateUpRelativeReturn1Y": excess("rate > 0", n1, 30), "rateUpRelativeReturn3Y": excess("rate > 0", n3, 90), "rateShockRelativeReturn1Y": excess("rate >= 0.0005", n1, 10),
        "curveFlatteningRelativeReturn3Y": excess("curve < 0", n3, 90), "creditSpreadWideningRelativeReturn1Y": excess("credit > 0", n1, 30),
        "creditShockRelativeReturn1Y": excess("credit >= 0.001", n1, 10), "rateBeta3Y": f"({slope('rate', n3, 90)}) * 0.01", "highYieldSpreadBeta3Y": f"({slope('credit', n3, 90)}) * 0.01",
    }
    for c in others:
        out |= {f"{c}Beta1Y": slope(c, n1, 30), f"{c}Beta3Y": slope(c, n3, 30), f"{c}Correlation3Y": corr(c, n3)}
    return out


_MARKET = f"""{sql.BARS.strip()}, {sql.SPY.strip()}, {sql.PROXIES.strip()}, {sql.MACRO.strip()},
b AS (SELECT * FROM spy UNION ALL SELECT * FROM proxies),
br AS (SELECT ticker, price_date AS d, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY price_date)) AS r FROM b),
bw AS (SELECT d, max(r) FILTER (ticker = 'SPY') AS spy, max(r) FILTER (ticker = 'ECONOMY') AS qqq, max(r) FILTER (ticker = 'SMALL') AS dia FROM br WHERE r IS NOT NULL GROUP BY d),
mc AS (SELECT series_id, observation_date AS d, value, (value - lag(value) OVER (PARTITION BY series_id ORDER BY observation_date)) / 100 AS change FROM macro WHERE value IS NOT NULL),
mw AS (SELECT d, max(change) FILTER (series_id = 'rate') AS rate, max(change) FILTER (series_id = 'vix') AS curve, max(change) FILTER (series_id = 'spread') AS credit, max(value) FILTER (series_id = 'vix') AS vix FROM mc GROUP BY d),
market AS (SELECT coalesce(bw.d, mw.d) AS d, spy, qqq, dia, rate, curve, credit, vix FROM bw FULL JOIN mw ON bw.d = mw.d)"""


def _numbered(source: str, name: str, snap: str = "") -> str:
    k = "ticker, as_of" if snap else "ticker"
    return f"""
{name}_r AS (SELECT ticker, price_date, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY price_date)) AS r FROM {source} QUALIFY count(*) OVER (PARTITION BY ticker) >= 252),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY price_date DESC) AS rn FROM {name}_r {snap}),
{name}_p AS (SELECT *, max(close) OVER (PARTITION BY {k} ORDER BY price_date ROWS UNBOUNDED PRECEDING) AS peak FROM {name}_n WHERE rn <= 252),
{name}_j AS (SELECT n.*, p.peak, market.* EXCLUDE (d) FROM {name}_n n LEFT JOIN {name}_p p USING ({k}, rn) LEFT JOIN market ON market.d = n.price_date WHERE n.rn <= 757)"""


def _long(name: str, keys: str, names: dict[str, str]) -> str:
    cols = ", ".join(f'{v} AS "{k}"' for k, v in names.items())
    listed = ", ".join(f'"{k}"' for k in names)
    return f"""
{name}_w AS (SELECT {keys}, max(price_date) AS effective_date, {cols} FROM {name}_j GROUP BY {keys}),
{name}_l AS (SELECT {keys}, effective_date, feature_key, feature_value FROM (UNPIVOT {name}_w ON {listed} INTO NAME feature_key VALUE feature_value))"""


_SNAP = ", (SELECT CAST(DATE '1998-12-31' + to_years(CAST(i AS INT)) AS DATE) AS as_of FROM range(4) t(i)) WHERE price_date <= as_of"

SQL = {
    "price_features": f"""WITH {_MARKET},{_numbered('bars', 'x')},{_long('x', 'ticker', _features(('qqq', 'dia')))}
SELECT ticker, effective_date, feature_key, round(feature_value, 6) AS feature_value FROM x_l""",
    "relative_price_features": f"""WITH {_MARKET},{_numbered('bars', 'x')},{_long('x', 'ticker', {k: v for k, v in _features().items() if k in RELATIVE})},
{_numbered('spy', 'y').strip()},{_long('y', 'ticker', {k: v for k, v in _features().items() if k in RELATIVE})}
SELECT x.ticker, x.effective_date, CASE x.feature_key {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in RELATIVE.items())} END AS feature_key, round(x.feature_value - y.feature_value, 6) AS feature_value
FROM x_l x JOIN y_l y USING (feature_key)""",
    "price_feature_timeline": f"""WITH {_MARKET},{_numbered('bars', 'x', _SNAP)},{_long('x', 'ticker, as_of', _features())}
SELECT ticker, as_of, effective_date, feature_key, round(feature_value, 6) AS feature_value FROM x_l""",
    "proxy_betas": f"""WITH {sql.BARS.strip()}, {sql.PROXIES.strip()},
m(definition, ticker) AS (VALUES {', '.join(f"('{d}', '{t}')" for d, ts in BASKETS.items() for t in ts)}),
pr AS (SELECT ticker, price_date AS d, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY price_date)) AS r FROM proxies),
k AS (SELECT definition, d, avg(r) AS basket FROM pr JOIN m USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2),
n AS (SELECT ticker, price_date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY price_date)) AS r, row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) AS rn FROM bars QUALIFY count(*) OVER (PARTITION BY ticker) >= 756)
SELECT ticker, definition, round(covar_samp(r, basket) / var_samp(basket), 6) AS beta, count(r) AS pairs FROM n JOIN k ON d = price_date WHERE rn <= 756 AND r IS NOT NULL GROUP BY 1, 2 HAVING count(r) >= 90""",
    "daily_returns": f"""WITH {sql.BARS.strip()}
SELECT ticker, price_date, round(ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY price_date)), 6) AS log_return FROM bars QUALIFY lag(close) OVER (PARTITION BY ticker ORDER BY price_date) IS NOT NULL""",
    "macro_changes": f"""WITH {sql.MACRO.strip()}
SELECT series_id, observation_date, round(value, 8) AS value, round((value - lag(value) OVER (PARTITION BY series_id ORDER BY observation_date)) / 100, 8) AS change FROM macro WHERE value IS NOT NULL""",
    "macro_overview": f"""WITH {sql.MACRO.strip()},
v AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observation_date DESC) AS rn FROM macro WHERE value IS NOT NULL)
SELECT series_id, max(observation_date) FILTER (rn = 1) AS latest_date, round(max(value) FILTER (rn = 1), 8) AS latest_value, max(observation_date) FILTER (rn = 2) AS previous_date, round(max(value) FILTER (rn = 2), 8) AS previous_value,
  (SELECT count(*) FROM macro m WHERE m.series_id = v.series_id) AS n_observations, count(*) AS n_valid
FROM v GROUP BY series_id""",
    "stale_filter": f"""WITH {sql.BARS.strip()}, {sql.PROXIES.strip()}, a AS (SELECT * FROM bars UNION ALL SELECT * FROM proxies)
SELECT ticker, count(*) AS bars, max(price_date) AS last_bar FROM a GROUP BY ticker HAVING abs(max(price_date) - DATE '2001-11-07') <= 7""",
}
