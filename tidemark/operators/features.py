"""Feature definitions as data, compiled to columns: every definition is an expression over one windowed pass."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_number, deviation, ratio_to_size
from tidemark.operators.relational import as_of
from tidemark.session import FEATURES_A_TASK, dealt


@dataclass(frozen=True)
class Feature:
    """One registered feature of a metric.

    ``method`` is one of direct, negative_direct, positive_ratio, negative_ratio, valid_ratio,
    ratio_to_denominator, spread_to_denominator, ratio_deviation, lag_ratio_deviation,
    relative_deviation, negative_relative_deviation, turnaround_momentum, macro_sensitivity_beta.
    """

    factor: str
    axis: str
    metric_key: str
    feature_key: str
    method: str
    source: str = "val"
    reference: str = "rolling4_avg"
    denominator: str | None = None
    denominator_source: str = "val"
    counterpart: str | None = None
    counterpart_source: str = "val"
    lookback: int = 8
    lag: int = 4
    macro_series: str | None = None
    macro_scale: float = 1.0
    in_vector: bool = True


def registry_frame(spark: SparkSession, definitions: list[Feature]) -> DataFrame:
    """The registry as a table, as it is stored and joined."""
    return spark.createDataFrame([asdict(d) for d in definitions], ", ".join(
        f"{f.name} " + {"lookback": "int", "lag": "int", "macro_scale": "double", "in_vector": "boolean"}.get(f.name, "string") for f in fields(Feature)
    ))


def read_registry(df: DataFrame) -> list[Feature]:
    """The definitions of a registry table, which is small by nature (one row per feature); unknown columns are ignored."""
    names = [f.name for f in fields(Feature)]
    return [Feature(**{k: v for k, v in r.asDict().items() if k in names and v is not None}) for r in df.collect()]


class _Compiler:
    """Columns over one company's rows, in one window partitioning (cik)."""

    def __init__(self, df: DataFrame):
        self.kinds = dict(df.dtypes)
        self.series = Window.partitionBy("cik", "metric_key").orderBy("end")
        self.company = Window.partitionBy("cik").orderBy("__day").rangeBetween(Window.unboundedPreceding, 0)

    def source(self, name: str) -> Column:
        return as_number(F.col(name), self.kinds[name])

    def as_of(self, metric: str, source: str) -> Column:
        """The last row of another metric of the company that ends no later; its value may be null."""
        row = F.when(F.col("metric_key") == metric, F.struct(self.source(source).alias("v")))
        return F.last(row, ignorenulls=True).over(self.company)["v"]

    def share(self, d: Feature, test) -> Column:
        frame = self.series.rowsBetween(-(d.lookback - 1), 0)
        x = self.source(d.source)
        known = F.count(x).over(frame)
        hits = F.sum(F.when(test(x), 1).otherwise(0)).over(frame)
        return F.when((F.count(F.lit(1)).over(frame) == d.lookback) & (known > 0), hits / known)

    def value(self, d: Feature) -> Column:
        x = self.source(d.source)
        if d.method == "direct":
            return x
        if d.method == "negative_direct":
            return -x
        if d.method == "positive_ratio":
            return self.share(d, lambda v: v > 0)
        if d.method == "negative_ratio":
            return self.share(d, lambda v: v < 0)
        if d.method == "valid_ratio":
            frame = self.series.rowsBetween(-(d.lookback - 1), 0)
            return F.when(F.count(F.lit(1)).over(frame) == d.lookback, F.count(x).over(frame) / d.lookback)
        if d.method == "ratio_to_denominator":
            return ratio_to_size(x, self.as_of(d.denominator, d.denominator_source))
        if d.method == "spread_to_denominator":
            return ratio_to_size(x - self.as_of(d.counterpart, d.counterpart_source), self.as_of(d.denominator, d.denominator_source))
        if d.method == "ratio_deviation":
            return deviation(x, self.source(d.reference))
        if d.method == "lag_ratio_deviation":
            return deviation(x, F.lag(x, d.lag).over(self.series))
        if d.method in ("relative_deviation", "negative_relative_deviation"):
            away = ratio_to_size(x - self.source(d.reference), self.source(d.reference))
            return -away if d.method.startswith("negative") else away
        if d.method == "turnaround_momentum":
            flags = [F.col(c) for c in ("is_turnaround", "is_loss_narrowing", "is_deterioration")]
            told = F.when(flags[0], 1.0).when(flags[1], 0.5).when(flags[2], -1.0)
            return told.when(flags[0].isNotNull() | flags[1].isNotNull() | flags[2].isNotNull(), 0.0)
        if d.method == "macro_sensitivity_beta":
            frame, m = self.series.rowsBetween(-19, 0), F.col("macro")[d.macro_series] * d.macro_scale
            both = x.isNotNull() & m.isNotNull()
            enough = (F.count(F.when(both, 1)).over(frame) >= 12) & (F.var_samp(F.when(both, m)).over(frame) > 0)
            return F.when(enough, F.regr_slope(F.when(both, x), F.when(both, m)).over(frame))
        raise ValueError(f"no such method: {d.method}")


def emit(enriched: DataFrame, definitions: list[Feature]) -> DataFrame:
    """One row per series row and definition of its metric: the feature table, without nulls.

    ``enriched`` holds flow and instant rows with one set of columns; a map column ``macro``
    (series -> value as of the row's end) is needed only by macro betas. All definitions are
    computed in one pass: one shuffle by company. Definitions that ask the same of different
    metrics share one computed column, so the work is rows by different questions, and a row
    takes from them what its metric asks for.
    """
    df = enriched.withColumn("__day", F.unix_date("end"))
    compiler, values, by_metric = _Compiler(df), {}, {}
    for d in definitions:
        own = replace(d, factor="", axis="", feature_key="", metric_key="")
        name = values.setdefault(own, f"__v{len(values)}")
        by_metric.setdefault(d.metric_key, []).append(F.struct(*[F.lit(getattr(d, k)).alias(k) for k in ("factor", "axis", "feature_key")], F.col(name).alias("feature_value")))
    df = df.where(F.col("metric_key").isin(*by_metric, *{m for d in definitions for m in (d.denominator, d.counterpart) if m}))
    computed = df.withColumns({name: compiler.value(d).cast("double") for d, name in values.items()})
    told = None
    for metric, items in by_metric.items():
        told = (F if told is None else told).when(F.col("metric_key") == metric, F.array(*items))
    computed = computed.withColumn("__all", told if told is not None else F.array().cast("array<struct<factor:string,axis:string,feature_key:string,feature_value:double>>"))
    found = computed.withColumn("__f", F.explode(F.filter("__all", lambda x: x["feature_value"].isNotNull())))
    return found.select(
        "ticker", "cik", F.col("__f.factor").alias("factor"), F.col("__f.axis").alias("axis"), "metric_key", F.col("__f.feature_key").alias("feature_key"),
        F.col("__f.feature_value").alias("feature_value"), F.col("end").alias("period_end"), "effective_date",
    )


def with_macro(enriched: DataFrame, macro: DataFrame, series: list[str]) -> DataFrame:
    """Adds ``macro``: for each named series the last value at or before the row's end.

    The distinct period ends, few whatever the number of companies, are looked up in each series by one as-of join, and
    joined back by equality.
    """
    known = macro.where(F.col("series_id").isin(*series) & F.col("value").isNotNull()).select("series_id", "observation_date", "value")
    asked = enriched.select("end").distinct().withColumn("series_id", F.explode(F.array(*map(F.lit, series))))
    found = as_of(asked, known, ["series_id"], "end", "observation_date", tie=["value"]).where("value is not null")
    at = found.groupBy("end").agg(F.map_from_entries(F.collect_list(F.struct("series_id", "value"))).alias("macro"))
    return enriched.join(at, "end", "left")


def normalize_sign(features: DataFrame, profiles: DataFrame, least_confidence: float = 0.8) -> DataFrame:
    """Feature values by the company's sign profile of the metric: kept, inverted, or dropped where it isn't known.

    ``profiles`` (cik, metric_key, kind, confidence): kind is positive, negative or mixed.
    """
    joined = features.join(profiles.select("cik", "metric_key", "kind", "confidence"), ["cik", "metric_key"], "left")
    sure = F.col("confidence") >= least_confidence
    value = F.when(sure & (F.col("kind") == "positive"), F.col("feature_value")).when(sure & (F.col("kind") == "negative"), -F.col("feature_value"))
    return joined.withColumn("feature_value", value).where("feature_value is not null").drop("kind", "confidence")


def sign_profiles(series: DataFrame, keys: tuple[str, ...] = ("cik", "metric_key")) -> DataFrame:
    """Shares of positive, negative and zero values; the dominant sign at 0.9 with five samples or more.

    Confidence is the dominant share times min(n / 20, 1), rounded to four places.
    """
    shares = series.where("val is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(F.expr(f"if(val {op} 0, 1D, 0D)")).alias(k) for k, op in (("positive_share", ">"), ("negative_share", "<"), ("zero_share", "="))]
    )
    dominance = F.greatest("positive_share", "negative_share")
    kind = F.when((F.col("n") >= 5) & (F.col("positive_share") >= 0.9), "positive").when((F.col("n") >= 5) & (F.col("negative_share") >= 0.9), "negative").otherwise("mixed")
    return shares.withColumn("kind", kind).withColumn("confidence", F.round(dominance * F.least(F.col("n") / 20, F.lit(1.0)), 4))


def latest_features(features: DataFrame, as_of: str | None = None) -> DataFrame:
    """The latest known value per entity, factor, axis, metric and feature; share classes with one cik are one entity.

    Order: effective date, then period end, both descending, then ticker.
    """
    known = features.where(F.col("feature_value").isNotNull())
    if as_of:
        known = known.where(F.col("effective_date") <= F.lit(as_of).cast("date"))
    w = Window.partitionBy("entity", "factor", "axis", "metric_key", "feature_key").orderBy(F.desc("effective_date"), F.desc("period_end"), "ticker")
    keyed = dealt(known.withColumn("entity", F.coalesce("cik", "ticker")), FEATURES_A_TASK, "entity", "factor", "axis")
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def macro_contrast(features: DataFrame, macro: DataFrame, series: list[str]) -> DataFrame:
    """The latest value of each feature less the macro value (in per cent) as of its period end, per series."""
    latest = latest_features(features).withColumnRenamed("period_end", "end")
    told = with_macro(latest, macro, series).select("*", F.explode("macro").alias("series_id", "macro_value"))
    return told.withColumn("contrast", F.col("feature_value") - F.col("macro_value") / 100).withColumnRenamed("end", "period_end").drop("macro")


#: The macro series that a metric is held against, the first one first; DEFAULT_MACROS stand for every other metric.
METRIC_MACROS = {
    "capex_cash": ("private_investment_yoy", "nonresidential_fixed_investment_yoy"),
    "capex_incurred": ("private_investment_yoy", "nonresidential_fixed_investment_yoy"),
    "gross_profit": ("corporate_profits_yoy", "nominal_gdp_yoy"),
    "net_income": ("corporate_profits_yoy", "nominal_gdp_yoy"),
    "operating_cash_flow": ("corporate_profits_yoy", "nominal_gdp_yoy"),
    "operating_income": ("corporate_profits_yoy", "nominal_gdp_yoy"),
    "revenue": ("nominal_gdp_yoy", "real_gdp_yoy", "pce_inflation_yoy"),
}
DEFAULT_MACROS = ("nominal_gdp_yoy", "real_gdp_yoy")


def macros_of(metric: Column, mapping: dict[str, tuple[str, ...]] = METRIC_MACROS, default: tuple[str, ...] = DEFAULT_MACROS) -> Column:
    """The names of a metric's macro series as an array; the default ones for a metric that isn't mapped, or null."""
    names = lambda keys: F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    told = F.create_map(*[c for m, keys in mapping.items() for c in (F.lit(m), names(keys))]) if mapping else F.create_map().cast("map<string,array<string>>")
    return F.coalesce(F.get(F.filter(F.array(F.try_element_at(told, metric)), lambda x: x.isNotNull()), 0), names(default))


def mapped_macros(features: DataFrame, macro: DataFrame, mapping: dict[str, tuple[str, ...]] = METRIC_MACROS, default: tuple[str, ...] = DEFAULT_MACROS) -> DataFrame:
    """The latest value of each feature beside those of its metric's macro series as of its period end: place (from 1), series_id, macro_value, contrast.

    A mapped series without an observation up to then stays, with nulls; the macro value is in per cent.
    """
    wanted = sorted({k for keys in (*mapping.values(), default) for k in keys})
    told = with_macro(latest_features(features).withColumnRenamed("period_end", "end"), macro.where(F.col("series_id").isin(*wanted)), wanted)
    rows = told.select("*", F.posexplode(macros_of(F.col("metric_key"), mapping, default)).alias("place", "series_id"))
    value = F.try_element_at("macro", F.col("series_id"))
    return rows.withColumns({"place": F.col("place") + 1, "macro_value": value, "contrast": F.col("feature_value") - value / 100}).withColumnRenamed("end", "period_end").drop("macro")


def comparison_members(companies: DataFrame, universe: DataFrame) -> DataFrame:
    """(ticker, comparison, member): every ticker against all, its universe and its sector, as group names."""
    base = companies.join(universe.where("is_active").select("ticker").distinct().withColumn("in_universe", F.lit(True)), "ticker", "left")
    groups = F.array(
        F.struct(F.lit("all").alias("comparison"), F.lit("all").alias("member_group")),
        F.when(F.col("in_universe"), F.struct(F.lit("universe").alias("comparison"), F.lit("universe").alias("member_group"))),
        F.when(F.col("sector").isNotNull(), F.struct(F.lit("sector").alias("comparison"), F.col("sector").alias("member_group"))),
    )
    return base.select("ticker", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g")).select("ticker", "g.*")


def vector_matrix(features: DataFrame, least_feature_share: float = 0.5, least_ticker_share: float = 0.5, method: str = "robust_z_score", clip: float = 3.0) -> DataFrame:
    """One dense vector per ticker over the features that enough tickers have: values in the order of feature_keys, observed, missing, coverage.

    ``features``: ticker, factor, axis, metric_key, feature_key, feature_value, one row each (of
    several the largest value counts). ``method``: robust_z_score (median and scaled MAD,
    the population deviation where that is 0, else 1; clipped), sign, or none. A missing value
    is 0; tickers below the least share are left out. Keys are as many as the registry has,
    so they travel as one row.
    """
    key = F.concat_ws(".", "factor", "axis", "metric_key", "feature_key")
    rows = features.where("feature_value is not null and ticker is not null").groupBy("ticker", key.alias("key")).agg(F.max(F.col("feature_value").cast("double")).alias("x"))
    every = rows.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("ticker") * F.lit(float(least_feature_share)))).alias("least"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.median("x").alias("centre"), F.stddev_pop("x").alias("sd"))
    kept = counted.join(F.broadcast(every), F.col("n") >= F.col("least")).select("key", "centre", "sd")
    placed = rows.join(kept, "key")
    if method == "robust_z_score":
        mad = placed.groupBy("key").agg((F.median(F.abs(F.col("x") - F.col("centre"))) * 1.4826).alias("mad"))
        scale = F.when(F.col("mad") != 0, F.col("mad")).when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)
        placed = placed.join(mad, "key").withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("x") - F.col("centre")) / scale)))
    else:
        placed = placed.withColumn("z", F.signum("x") if method == "sign" else F.col("x"))
    keys = kept.agg(F.array_sort(F.collect_list("key")).alias("feature_keys"))
    own = placed.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("key", "z"))).alias("m"))
    all_keys, m = F.col("feature_keys"), F.col("m")
    told = rows.select("ticker").distinct().join(own, "ticker", "left").crossJoin(F.broadcast(keys)).withColumn("observed", F.coalesce(F.size(F.map_keys(m)), F.lit(0)))
    told = told.withColumn("observed", F.greatest(F.lit(0), "observed")).withColumn("coverage", F.when(F.size(all_keys) > 0, F.col("observed") / F.size(all_keys)).otherwise(0.0))
    values = F.transform(all_keys, lambda k: F.coalesce(m[k], F.lit(0.0)))
    return told.where(F.col("coverage") >= least_ticker_share).select("ticker", "feature_keys", values.alias("values"), "observed", (F.size(all_keys) - F.col("observed")).alias("missing"), "coverage")
