"""The driver's star-schema tables read as filing, price and macro series.

A supplier stands for a company, a quarter of its line items for a filing, a brand for a
listed share, an order day for a macro observation. Missing fiscal fields are put in by
arithmetic on keys, so that fallbacks have rows to work on; no row of the tables is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: metric -> value of a supplier's quarter: r revenue, n quantity, s supplier.
FLOWS = {
    "revenue": "r", "net_income": "r - 1984 * n", "operating_cash_flow": "r - 1900 * n", "capex_cash": "50 * n",
    "eps_diluted": "(r - 1984 * n) / (1000 + s)", "eps_basic": "(r - 1984 * n) / (990 + s)",
    "dividend_payments": "10 * n", "share_repurchases": "5 * n",
}
#: metric -> value at a quarter's end: cr and cn are running sums of r and n.
INSTANTS = {
    "assets": "cr", "stockholders_equity": "cr - 1000 * cn", "shares_outstanding": "1000 + s",
    "short_term_debt": "20 * cn", "long_term_debt": "60 * cn", "cash_and_cash_equivalents": "30 * cn",
}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of ``sf_dir``; timestamps without zone that are dates become dates."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and quarter: s, start, end, qn, r, n and the running sums cr, cn."""
    items = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"])
    start = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    q = items.groupBy(F.col("l_suppkey").alias("s"), start.alias("start")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("r"), F.sum("l_quantity").alias("n")
    )
    w = Window.partitionBy("s").orderBy("start")
    return q.select(
        "s", "start", F.date_add(F.add_months("start", 3), -1).alias("end"), (F.year("start") * 4 + F.quarter("start") - 1).alias("qn"),
        "r", "n", F.round(F.sum("r").over(w), 4).alias("cr"), F.sum("n").over(w).alias("cn"),
    )


def _long(wide: DataFrame, values: dict[str, str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("metric_key"), F.expr(v).cast("double").alias("val")) for k, v in values.items()])
    flow = kind == "flow"
    fiscal = (F.col("s") + F.col("qn")) % 13 != 0
    return wide.withColumn("m", F.explode(pairs)).select(
        F.lpad(F.col("s").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("S"), F.col("s").cast("string")).alias("ticker"),
        "m.metric_key", F.lit(kind).alias("fact_type"), F.lit("USD").alias("unit"), "m.val",
        (F.col("start") if flow else F.lit(None).cast("date")).alias("start"), "end",
        F.date_add("end", 30).alias("filed"), F.date_add("end", 30).alias("effective_date"),
        (F.date_diff("end", "start") + 1 if flow else F.lit(None).cast("int")).alias("duration_days"),
        F.when(fiscal, F.floor(F.col("qn") / 4).cast("int")).alias("fiscal_year"), F.when(fiscal, F.col("qn") % 4 + 1).alias("fiscal_quarter"),
        F.lit("quarter" if flow else "instant").alias("period_type"),
    )


def flow_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly flows; every thirteenth lacks fiscal fields."""
    return _long(quarters(spark, sf_dir), FLOWS, "flow")


def instant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(quarters(spark, sf_dir), INSTANTS, "instant")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, ticker, listed (the brand whose price is the share's), company_name, sector, industry."""
    s = table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    small = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    return s.join(F.broadcast(small), s["s_nationkey"] == small["n_nationkey"]).select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("listed"),
        F.col("s_name").alias("company_name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
    )


def _price() -> Column:
    """The price a unit: cents and units are summed as whole numbers, so the order of rows changes nothing."""
    return F.round(F.sum(F.col("l_extendedprice") * 100)) / F.sum("l_quantity") / 100


def bars(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """Daily bars (ticker, price_date, close, volume): the price a unit of each brand, or part type."""
    items = table(spark, sf_dir, "lineitem", ["l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    part = table(spark, sf_dir, "part", ["p_partkey", by])
    day = F.col("l_shipdate").cast("date").alias("price_date")
    return items.join(part, items["l_partkey"] == part["p_partkey"]).groupBy(F.col(by).alias("ticker"), day).agg(
        _price().alias("close"), F.sum("l_quantity").alias("volume")
    )


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: the price a unit of all line items of a day, under the ticker SPY."""
    items = table(spark, sf_dir, "lineitem", ["l_shipdate", "l_quantity", "l_extendedprice"])
    return items.groupBy(F.col("l_shipdate").cast("date").alias("price_date")).agg(
        _price().alias("close"), F.sum("l_quantity").alias("volume")
    ).select(F.lit("SPY").alias("ticker"), "price_date", "close", "volume")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations (series_id, observation_date, value): rate, spread and vix, from orders.

    Every seventeenth day has a null value.
    """
    orders = table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice", "o_custkey"])
    day = F.col("o_orderdate").cast("date")
    cents = F.round(F.sum(F.col("o_totalprice") * 100))
    daily = orders.groupBy(day.alias("observation_date")).agg(
        (cents / F.count("*") / 1e7).alias("rate"), (F.sum("o_custkey") / F.count("*") / 100).alias("spread"), (cents / F.count("*") / 1e6).alias("vix")
    )
    known = F.unix_date("observation_date") % 17 != 0
    pairs = F.array(*[F.struct(F.lit(c).alias("series_id"), F.when(known, F.col(c)).alias("value")) for c in ("rate", "spread", "vix")])
    return daily.withColumn("m", F.explode(pairs)).select("m.series_id", "observation_date", "m.value")


def date_of(column: str) -> Column:
    return F.col(column).cast("date")
