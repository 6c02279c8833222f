"""Valuation composites of a price and the filings known by then, and the expectations a price implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import cagr, clamp01, log_positive, max_of, mean_of, ratio, sum_nullable
from tidemark.operators.relational import bitemporal_latest

#: The inputs of the composites, as (name, metric, period type, column).
INPUTS = [
    ("shares", "shares_outstanding", "instant", "val"), ("equity", "stockholders_equity", "instant", "val"),
    ("short_debt", "short_term_debt", "instant", "val"), ("long_debt", "long_term_debt", "instant", "val"), ("total_debt", "total_debt", "instant", "val"),
    ("cash_all", "cash_and_short_term_investments", "instant", "val"), ("cash", "cash_and_cash_equivalents", "instant", "val"),
    ("ocf", "operating_cash_flow", "quarter", "ttm_val"), ("capex_cash", "capex_cash", "quarter", "ttm_val"), ("capex_incurred", "capex_incurred", "quarter", "ttm_val"),
    ("eps_diluted", "eps_diluted", "quarter", "ttm_val"), ("eps_basic", "eps_basic", "quarter", "ttm_val"),
    ("revenue", "revenue", "quarter", "ttm_val"), ("net_income", "net_income", "quarter", "ttm_val"), ("operating_income", "operating_income", "quarter", "ttm_val"),
    ("dividends", "dividend_payments", "quarter", "ttm_val"), ("repurchases", "share_repurchases", "quarter", "ttm_val"),
]
GROWTHS = [("eps_diluted_growth", "eps_diluted", "ttm_yoy"), ("eps_basic_growth", "eps_basic", "ttm_yoy")]

#: Assumption sets (key, years, discount rate, terminal EV/sales, terminal P/E, terminal margin).
ASSUMPTIONS = [("conservative_5y", 5, 0.12, 4.0, 18.0, 0.15), ("base_5y", 5, 0.10, 8.0, 25.0, 0.25), ("growth_5y", 5, 0.08, 12.0, 35.0, 0.35)]


def known_inputs(enriched: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per company and snapshot: each input's latest known value, its period end and its effective date.

    Latest is by effective date, then end, of the rows known by the snapshot. One shuffle by
    company and metric, one aggregate by company and snapshot.
    """
    wanted = {(m, p) for _, m, p, _ in INPUTS}
    rows = enriched.where(F.col("metric_key").isin(*{m for m, _ in wanted}))
    latest = bitemporal_latest(rows.select("cik", "metric_key", "period_type", "end", "effective_date", "val", "ttm_val", "ttm_yoy"), snapshots, ["cik", "metric_key", "period_type"])
    columns: list[Column] = []
    for name, metric, period, source in INPUTS:
        at = (F.col("metric_key") == metric) & (F.col("period_type") == period)
        columns += [F.max(F.when(at, F.col(c))).alias(a) for a, c in ((name, source), (f"{name}_end", "end"), (f"{name}_known", "effective_date"))]
    for name, metric, source in GROWTHS:
        columns.append(F.max(F.when((F.col("metric_key") == metric) & (F.col("period_type") == "quarter"), F.col(source))).alias(name))
    return latest.groupBy("cik", "as_of").agg(*columns)


def enterprise(cap: Column) -> Column:
    """Capitalisation and debt less cash: debt is short plus long, else the total, else either; cash with short-term investments first."""
    debt = F.coalesce(F.col("short_debt") + F.col("long_debt"), F.col("total_debt"), sum_nullable(F.col("short_debt"), F.col("long_debt")), F.lit(0.0))
    return cap + debt - F.coalesce("cash_all", "cash", F.lit(0.0))


def composites(inputs: DataFrame, prices: DataFrame) -> DataFrame:
    """Long rows (cik, ticker, as_of, metric_key, metric_value, period_end, effective_date), nulls left out.

    ``prices`` (cik, ticker, as_of, price_date, close): closes that aren't above 0 give nothing.
    A multiple is null unless its denominator is above 0.
    """
    df = inputs.join(prices.where("close > 0"), ["cik", "as_of"])
    close = F.col("close")
    df = df.withColumn("cap", F.when(F.col("shares") > 0, close * F.col("shares")))
    cap, day = F.col("cap"), F.col("price_date")
    df = df.withColumn("ev", enterprise(cap)).withColumn("dividend_yield", ratio(F.col("dividends"), cap)).withColumn("buyback_yield", ratio(F.col("repurchases"), cap))
    df = df.withColumn("shareholder_yield", sum_nullable(F.col("dividend_yield"), F.col("buyback_yield")))
    fcf = F.col("ocf") - F.coalesce("capex_cash", "capex_incurred")
    latest = lambda *names: F.coalesce(F.greatest(*[F.col(n) for n in names], F.lit(None).cast("date")), day)
    known = lambda *names: F.greatest(day, "shares_known", *[f"{n}_known" for n in names])
    own = lambda n: F.greatest(day, f"{n}_known")
    ends = lambda *names: latest(*[f"{n}_end" for n in names])
    everything = ("shares", "total_debt", "short_debt", "long_debt", "cash_all", "cash", "revenue")
    metrics = [
        ("market_capitalization", cap, ends("shares"), known()), ("log_market_capitalization", log_positive(cap), ends("shares"), known()),
        ("price_to_diluted_ttm_eps", ratio(close, F.col("eps_diluted")), ends("eps_diluted"), own("eps_diluted")),
        ("price_to_basic_ttm_eps", ratio(close, F.col("eps_basic")), ends("eps_basic"), own("eps_basic")),
        ("diluted_ttm_eps_growth", F.col("eps_diluted_growth"), ends("eps_diluted"), F.coalesce("eps_diluted_known", day)),
        ("basic_ttm_eps_growth", F.col("eps_basic_growth"), ends("eps_basic"), F.coalesce("eps_basic_known", day)),
        ("price_to_book", ratio(cap, F.col("equity")), ends("equity"), known("equity")), ("price_to_sales", ratio(cap, F.col("revenue")), ends("revenue"), known("revenue")),
        ("price_to_earnings", ratio(cap, F.col("net_income")), ends("net_income"), known("net_income")),
        ("price_to_operating_cash_flow", ratio(cap, F.col("ocf")), ends("ocf"), known("ocf")),
        ("free_cash_flow_yield", ratio(fcf, cap), ends("ocf", "capex_cash", "capex_incurred"), known("ocf", "capex_cash", "capex_incurred")),
        ("enterprise_value_to_sales", ratio(F.col("ev"), F.col("revenue")), ends(*everything), known(*everything[1:])),
        ("dividend_yield", F.col("dividend_yield"), ends("dividends"), known("dividends")), ("buyback_yield", F.col("buyback_yield"), ends("repurchases"), known("repurchases")),
        ("shareholder_yield", F.col("shareholder_yield"), ends("dividends", "repurchases"), known("dividends", "repurchases")),
        ("dividend_yield_share", ratio(F.col("dividend_yield"), F.col("shareholder_yield")), ends("dividends", "repurchases"), known("dividends", "repurchases")),
        ("buyback_yield_share", ratio(F.col("buyback_yield"), F.col("shareholder_yield")), ends("dividends", "repurchases"), known("dividends", "repurchases")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("metric_key"), v.cast("double").alias("metric_value"), e.alias("period_end"), d.alias("effective_date")) for k, v, e, d in metrics])
    return df.select("cik", "ticker", "as_of", F.explode(rows).alias("m")).select("cik", "ticker", "as_of", "m.*").where("metric_value is not null")


def expectations(inputs: DataFrame, prices: DataFrame, assumptions: list[tuple] = ASSUMPTIONS) -> DataFrame:
    """What a price implies under each assumption set: terminal values, growth rates, burden and fragility scores."""
    sets = F.array(*[F.struct(
        F.lit(k).alias("assumption_set"), F.lit(float(y)).alias("years"), F.lit(r).alias("rate"), F.lit(s).alias("ev_sales"), F.lit(p).alias("pe"), F.lit(m).alias("margin")
    ) for k, y, r, s, p, m in assumptions])
    df = inputs.join(prices.where("close > 0"), ["cik", "as_of"]).withColumn("cap", F.when(F.col("shares") > 0, F.col("close") * F.col("shares")))
    df = df.withColumn("ev", enterprise(F.col("cap"))).withColumn("a", F.explode(sets)).select("*", "a.*").drop("a")
    factor = F.pow(1 + F.col("rate"), F.col("years"))
    df = df.withColumn("terminal_ev", F.col("ev") * factor).withColumn("terminal_equity", F.col("cap") * factor)
    df = df.withColumn("implied_revenue", F.col("terminal_ev") / F.col("ev_sales")).withColumn("implied_net_income", F.col("terminal_equity") / F.col("pe"))
    df = df.withColumn("implied_eps", ratio(F.col("implied_net_income"), F.col("shares")))
    grown = lambda now, then: cagr(F.col(then), F.col(now), F.col("years"))
    df = df.withColumn("revenue_cagr", grown("revenue", "implied_revenue")).withColumn("net_income_cagr", grown("net_income", "implied_net_income")).withColumn("eps_cagr", grown("eps_diluted", "implied_eps"))
    df = df.withColumn("ev_to_sales", ratio(F.col("ev"), F.col("revenue"))).withColumn("price_to_earnings", ratio(F.col("cap"), F.col("net_income")))
    rate = lambda c: clamp01((F.col(c) - 0.02) / 0.28)
    burden = mean_of([max_of([rate("revenue_cagr"), rate("net_income_cagr")]), clamp01((F.col("margin") - 0.05) / 0.45)])
    fragility = mean_of([clamp01(F.col("ev_to_sales") / F.col("ev_sales") / 2), clamp01(F.col("price_to_earnings") / F.col("pe") / 2)])
    return df.select(
        "cik", "ticker", "as_of", "assumption_set", "cap", "ev", "terminal_ev", "terminal_equity", "implied_revenue", "revenue_cagr", (F.col("implied_revenue") * F.col("margin")).alias("implied_operating_income"),
        "implied_net_income", "net_income_cagr", "implied_eps", "eps_cagr", "ev_to_sales", "price_to_earnings",
        ratio(F.col("net_income"), F.col("revenue")).alias("net_margin"), burden.alias("burden_score"), fragility.alias("fragility_score"),
    )
