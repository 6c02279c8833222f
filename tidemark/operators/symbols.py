"""A vendor's symbol for a ticker: candidates in order of preference, resolved by rank in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.filings import ticker as normal

#: The exchanges that are preferred, and the letters of share classes that are written together with the ticker.
EXCHANGES, CLASSES = ("NYSE", "NASDAQ", "AMEX"), ("A", "B", "C")
PROVIDER = "vendor"


def share_class_candidates(t: Column) -> Column:
    """The symbols to try if a ticker itself isn't listed: BRK-B and BRKB are tried as BRK.B."""
    dashed = F.when(t.rlike("^[A-Z]{1,4}-[A-Z]$"), F.array(F.replace(t, F.lit("-"), F.lit("."))))
    joined = F.when(t.rlike("^[A-Z]{3,5}$") & F.right(t, F.lit(1)).isin(*CLASSES), F.array(F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("."), F.right(t, F.lit(1)))))
    return F.coalesce(dashed, joined, F.array().cast("array<string>"))


def resolve(tickers: DataFrame, catalog: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a ticker: provider_symbol, exchange, status (verified, unresolved or what was known), source, candidates.

    ``catalog``: listing (its order), symbol, exchange, kind (stock, etf). The ticker itself is tried before its share class
    forms, stocks before funds, preferred exchanges before others, then the first listed. ``known`` (ticker, provider_symbol, exchange,
    status, source): a disabled row that wasn't skipped by rule, or a verified one with a symbol and an exchange, stands
    as it is. Tickers are trimmed and in capitals; those that become equal are one, empty ones none.
    """
    asked = tickers.select(normal(F.col("ticker")).alias("ticker")).where("ticker <> ''").distinct()
    tried = asked.select("ticker", F.posexplode(F.concat(F.array("ticker"), share_class_candidates(F.col("ticker")))).alias("step", "candidate"))
    listed = catalog.select(F.upper("symbol").alias("candidate"), "symbol", "exchange", "kind", "listing").where("symbol is not null")
    met = tried.join(listed, "candidate", "left")
    rank = F.struct("step", (F.col("kind") != "stock").alias("fund"), (~F.coalesce(F.col("exchange").isin(*EXCHANGES), F.lit(False))).alias("elsewhere"), "listing")
    found = met.groupBy("ticker").agg(
        F.min_by(F.struct("symbol", "exchange", "step"), F.when(F.col("symbol").isNotNull(), rank)).alias("m"), F.array_sort(F.collect_set("symbol")).alias("candidates")
    )
    m = F.col("m")
    told = found.select(
        "ticker", m["symbol"].alias("provider_symbol"), m["exchange"].alias("exchange"), F.when(m["symbol"].isNotNull(), "verified").otherwise("unresolved").alias("status"),
        F.when(m["step"] > 0, "auto_compact_share_class_fallback").otherwise("auto").alias("source"), "candidates",
    )
    if known is None:
        return told
    settled = ((F.col("status") == "disabled") & (F.col("source") != "auto_skip_share_class")) | ((F.col("status") == "verified") & F.col("provider_symbol").isNotNull() & F.col("exchange").isNotNull())
    kept = known.where(settled).select("ticker", "provider_symbol", "exchange", "status", "source", F.array().cast("array<string>").alias("candidates"))
    return told.join(kept.select("ticker"), "ticker", "left_anti").unionByName(asked.join(kept, "ticker").select(*told.columns))
