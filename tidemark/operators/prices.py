"""Features of daily bars: returns, volatility, drawdown, betas, captures and conditional returns.

Bars are numbered back from each ticker's last one, so that "a year ago" is the bar 252
places back. The benchmarks and macro changes form one wide table by date, which is joined
once; all features then come out of one aggregate per ticker and snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import if_small

#: Bars in a month, a quarter, half a year, a year and three years; thresholds of the conditions.
MONTH, QUARTER, HALF, YEAR, THREE_YEARS = 21, 63, 126, 252, 756
VIX_STRESS, RATE_SHOCK, CREDIT_SHOCK = 25.0, 0.0005, 0.001
STALE_DAYS = 7


@dataclass(frozen=True)
class Gates:
    """How many observations a feature needs; the defaults are the production gates."""

    bars: int = 252
    pairs: int = 30
    capture: int = 10
    macro: int = 90


def valid_bars(bars: DataFrame, least: int = 252) -> DataFrame:
    """Bars with a finite close above 0, of tickers with at least ``least`` of them."""
    good = bars.where((F.col("close") > 0) & (F.col("close") < float("inf")))
    enough = good.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("ticker")
    return good.join(if_small(enough), "ticker", "left_semi")


def fresh_tickers(bars: DataFrame, reference: Column) -> DataFrame:
    """The bars of tickers whose last bar is within a week of the reference date."""
    last = bars.groupBy("ticker").agg(F.max("price_date").alias("last")).where(F.abs(F.date_diff(reference, "last")) <= STALE_DAYS)
    return bars.join(if_small(last.select("ticker")), "ticker", "left_semi")


def without(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """Benchmarks are inputs and no outputs."""
    return bars.where(~F.col("ticker").isin(*tickers)) if tickers else bars


def daily_log_returns(bars: DataFrame) -> DataFrame:
    """(ticker, price_date, log_return) between consecutive bars."""
    w = Window.partitionBy("ticker").orderBy("price_date")
    told = bars.withColumn("log_return", F.log(F.col("close") / F.lag("close").over(w)))
    return told.where("log_return is not null").select("ticker", "price_date", "log_return")


def macro_changes(macro: DataFrame) -> DataFrame:
    """(series_id, observation_date, value, change): hundredths of the step between non-null observations."""
    w = Window.partitionBy("series_id").orderBy("observation_date")
    known = macro.where("value is not null")
    return known.withColumn("change", (F.col("value") - F.lag("value").over(w)) / 100)


def market_frame(benchmarks: DataFrame, macro: DataFrame, names: dict[str, str], changes: dict[str, str], levels: dict[str, str]) -> DataFrame:
    """One row per date: a column of log returns per benchmark, of changes and levels per macro series.

    Its rows are calendar days, about 250 a year whatever the number of tickers.
    """
    returns = daily_log_returns(benchmarks.where(F.col("ticker").isin(*names)))
    wide = returns.groupBy(F.col("price_date").alias("d")).agg(*[F.max(F.when(F.col("ticker") == t, F.col("log_return"))).alias(c) for t, c in names.items()])
    told = macro_changes(macro)
    parts = [F.max(F.when(F.col("series_id") == s, F.col("change"))).alias(c) for s, c in changes.items()]
    parts += [F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(c) for s, c in levels.items()]
    return wide.join(told.groupBy(F.col("observation_date").alias("d")).agg(*parts), "d", "full")


def numbered(bars: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Bars with log returns and ``rn``, counted back from the last bar of each ticker and snapshot.

    ``snapshots`` (as_of) is a short list of dates. A bar is joined only with the snapshots
    for which it is among the last 757: those before the bar 757 places later.
    """
    w = Window.partitionBy("ticker").orderBy("price_date")
    told = bars.select(
        "ticker", "price_date", "close", F.log(F.col("close") / F.lag("close").over(w)).alias("log_return"), F.lead("price_date", THREE_YEARS + 1).over(w).alias("__gone")
    )
    keys = ["ticker"]
    if snapshots is not None:
        match = (F.col("price_date") <= F.col("as_of")) & (F.col("__gone").isNull() | (F.col("__gone") > F.col("as_of")))
        told, keys = told.join(F.broadcast(snapshots.select("as_of").distinct()), match), ["ticker", "as_of"]
    back = Window.partitionBy(*keys).orderBy(F.desc("price_date"))
    return told.drop("__gone").withColumn("rn", F.row_number().over(back)).where(F.col("rn") <= THREE_YEARS + 1)


def _pick(n: int) -> Column:
    return F.max(F.when(F.col("rn") == n + 1, F.col("close")))


def _return(n: int) -> Column:
    return _pick(0) / _pick(n) - 1


def _slope(y: Column, x: Column, least: int) -> Column:
    """The regression slope of y on x over the rows where both are known, with enough of them and some variance."""
    both = y.isNotNull() & x.isNotNull()
    spread = F.var_samp(F.when(both, x))
    return F.when((F.count(F.when(both, 1)) >= least) & (spread > 0), F.regr_slope(y, x))


def _correlation(y: Column, x: Column, least: int) -> Column:
    both = y.isNotNull() & x.isNotNull()
    varied = (F.stddev_samp(F.when(both, x)) > 0) & (F.stddev_samp(F.when(both, y)) > 0)
    return F.when((F.count(F.when(both, 1)) >= least) & varied, F.corr(F.when(both, y), F.when(both, x)))


def _capture(y: Column, x: Column, side: Column, least: int) -> Column:
    at = y.isNotNull() & side
    base = F.sum(F.when(at, x))
    return F.when((F.count(F.when(at, 1)) >= least) & (base != 0), F.sum(F.when(at, y)) / base)


def _excess(y: Column, x: Column, condition: Column, least: int) -> Column:
    at = y.isNotNull() & x.isNotNull() & condition
    return F.when(F.count(F.when(at, 1)) >= least, F.sum(F.when(at, y - x)))


def feature_columns(gates: Gates = Gates(), benchmark: str = "spy", others: tuple[str, ...] = ()) -> dict[str, Column]:
    """Feature key -> aggregate over the rows of :func:`numbered` joined with the market frame.

    Expects rn, close, log_return, peak (the running maximum within a year) and the columns
    ``benchmark``, ``others``, rate, curve, credit (changes) and vix (level).
    """
    r, x, rn = F.col("log_return"), F.col(benchmark), F.col("rn")
    in1, in3 = rn <= YEAR, rn <= THREE_YEARS
    r1, r3 = F.when(in1, r), F.when(in3, r)
    months = [F.when(_pick(k * MONTH).isNotNull() & _pick((k + 1) * MONTH).isNotNull(), (_pick(k * MONTH) / _pick((k + 1) * MONTH) > 1).cast("int")) for k in range(12)]
    n1 = F.count(r1)
    features = {
        "priceReturn3M": _return(QUARTER), "priceReturn6M": _return(HALF), "priceReturn12M": _return(YEAR),
        "priceMomentum12MEx1M": _pick(MONTH) / _pick(YEAR) - 1,
        "momentumConsistency12M": F.when(_pick(YEAR).isNotNull(), sum(months[1:], months[0]) / 12),
        "distanceFrom52WeekHigh": F.when(F.count(F.when(in1, 1)) >= YEAR, _pick(0) / F.max(F.when(in1, F.col("close"))) - 1),
        "realizedVolatility1Y": F.when(n1 >= gates.pairs, F.stddev_samp(r1) * F.sqrt(F.lit(float(YEAR)))),
        "realizedVolatility3Y": F.when(F.count(r3) >= gates.pairs, F.stddev_samp(r3) * F.sqrt(F.lit(float(YEAR)))),
        "downsideVolatility1Y": F.when(F.count(F.when(r1 < 0, 1)) >= gates.capture, F.stddev_samp(F.when(r1 < 0, r1)) * F.sqrt(F.lit(float(YEAR)))),
        "maxDrawdown1Y": F.when(F.count(F.when(in1, 1)) >= gates.pairs, F.min(F.when(in1, F.col("close") / F.col("peak") - 1))),
        "marketBeta1Y": _slope(r1, x, gates.pairs), "marketBeta3Y": _slope(r3, x, gates.pairs),
        "correlationToMarket3Y": _correlation(r3, x, gates.pairs),
        "upsideCapture1Y": _capture(r1, x, x > 0, gates.capture), "downsideCapture1Y": _capture(r1, x, x < 0, gates.capture),
        "downsideCaptureDefense1Y": 1 - _capture(r1, x, x < 0, gates.capture),
        "downMarketDefense1Y": _excess(r1, x, x < 0, gates.pairs), "downMarketDefense3Y": _excess(r3, x, x < 0, gates.pairs),
        "volatilityStressDefense1Y": _excess(r1, x, F.col("vix") >= VIX_STRESS, gates.capture),
        "volatilityStressDefense3Y": _excess(r3, x, F.col("vix") >= VIX_STRESS, gates.capture),
        "rateUpRelativeReturn1Y": _excess(r1, x, F.col("rate") > 0, gates.pairs), "rateUpRelativeReturn3Y": _excess(r3, x, F.col("rate") > 0, gates.macro),
        "rateShockRelativeReturn1Y": _excess(r1, x, F.col("rate") >= RATE_SHOCK, gates.capture),
        "curveFlatteningRelativeReturn3Y": _excess(r3, x, F.col("curve") < 0, gates.macro),
        "creditSpreadWideningRelativeReturn1Y": _excess(r1, x, F.col("credit") > 0, gates.pairs),
        "creditShockRelativeReturn1Y": _excess(r1, x, F.col("credit") >= CREDIT_SHOCK, gates.capture),
        "rateBeta3Y": _slope(r3, F.col("rate"), gates.macro) * 0.01, "highYieldSpreadBeta3Y": _slope(r3, F.col("credit"), gates.macro) * 0.01,
    }
    for c in others:
        features |= {f"{c}Beta1Y": _slope(r1, F.col(c), gates.pairs), f"{c}Beta3Y": _slope(r3, F.col(c), gates.pairs), f"{c}Correlation3Y": _correlation(r3, F.col(c), gates.pairs)}
    return features


def price_features(bars: DataFrame, market: DataFrame, snapshots: DataFrame | None = None, gates: Gates = Gates(), others: tuple[str, ...] = ()) -> DataFrame:
    """Features of every ticker (and snapshot): (ticker, [as_of], effective_date, feature_key, feature_value).

    ``market`` is a :func:`market_frame`. Nulls aren't emitted. Tickers below the gate of
    bars have no features.
    """
    keys = ["ticker"] + ["as_of"] * (snapshots is not None)
    rows = numbered(valid_bars(bars, gates.bars), snapshots)
    peak = Window.partitionBy(*keys).orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("peak", F.max(F.when(F.col("rn") <= YEAR, F.col("close"))).over(peak))
    joined = rows.join(if_small(market), rows["price_date"] == market["d"], "left")
    features = feature_columns(gates, others=others)
    wide = joined.groupBy(*keys).agg(F.max("price_date").alias("effective_date"), *[c.alias(k) for k, c in features.items()])
    return unpivot(wide, [*keys, "effective_date"], list(features))


def unpivot(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns as rows (feature_key, feature_value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_key"), F.col(n).cast("double").alias("feature_value")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("f")).select(*keys, "f.*").where("feature_value is not null")


def relative_features(features: DataFrame, benchmark: DataFrame, names: dict[str, str]) -> DataFrame:
    """Features less the benchmark's own of the same key: ``names`` maps a key to the relative key.

    ``benchmark`` holds the benchmark's features, one row per key.
    """
    own = benchmark.select("feature_key", F.col("feature_value").alias("__b"))
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        features.where(F.col("feature_key").isin(*names)).join(F.broadcast(own), "feature_key")
        .withColumn("feature_value", F.col("feature_value") - F.col("__b")).withColumn("feature_key", renamed[F.col("feature_key")]).drop("__b")
    )


def basket_returns(returns: DataFrame, members: DataFrame) -> DataFrame:
    """(definition, d, basket): the mean return by date of each definition's members that have one."""
    return returns.join(if_small(members), "ticker").groupBy("definition", F.col("price_date").alias("d")).agg(F.avg("log_return").alias("basket"))


def proxy_betas(bars: DataFrame, baskets: DataFrame, least_bars: int = 756, least_pairs: int = 90) -> DataFrame:
    """(ticker, definition, beta, pairs): the slope on each basket over the last 756 returns.

    Baskets are definitions times calendar days: their number of rows is checked before a broadcast.
    """
    rows = numbered(valid_bars(bars, least_bars)).where(F.col("rn") <= THREE_YEARS)
    joined = rows.join(if_small(baskets), rows["price_date"] == baskets["d"])
    beta = _slope(F.col("log_return"), F.col("basket"), least_pairs)
    return joined.groupBy("ticker", "definition").agg(beta.alias("beta"), F.count("log_return").alias("pairs")).where("beta is not null")
