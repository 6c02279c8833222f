"""Portfolio arithmetic: completion, weights, buy-only rebalancing, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASH = "CASH"


def complete(items: DataFrame) -> DataFrame:
    """Of shares, average price and total cost the one that lacks is derived; 0 counts as lacking."""
    s, p, c = (F.nullif(F.col(n), F.lit(0.0)) for n in ("shares", "average_price", "total_cost"))
    return (
        items.withColumn("__c", F.coalesce(c, s * p)).withColumn("__p", F.coalesce(p, F.col("__c") / s)).withColumn("__s", F.coalesce(s, F.col("__c") / F.col("__p")))
        .withColumns({"shares": F.col("__s"), "average_price": F.col("__p"), "total_cost": F.col("__c")}).drop("__s", "__p", "__c")
    )


def valued(items: DataFrame, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """Adds current_value (shares at the current price, else the cost) and current_weight in per cent of the portfolio."""
    value = F.coalesce(F.col("shares") * F.col("current_price"), F.col("total_cost"), F.lit(0.0))
    total = F.sum("current_value").over(Window.partitionBy(*keys))
    return items.withColumn("current_value", value).withColumn("current_weight", F.when(total > 0, F.col("current_value") / total * 100))


def rebalance(items: DataFrame, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """Cash above its target is dealt to the holdings below theirs, in proportion to what they lack; nothing is sold.

    Without a target for cash nothing is investable. The cash row shows what leaves it.
    """
    w = Window.partitionBy(*keys)
    cash = F.col("ticker") == CASH
    total = F.sum("current_value").over(w)
    df = items.withColumn("__total", total).withColumn("__cash", F.max(F.when(cash, F.col("current_value"))).over(w)).withColumn("__aim", F.max(F.when(cash, F.col("target_weight"))).over(w))
    investable = F.when(F.col("__aim").isNotNull(), F.greatest(F.col("__cash") - F.col("__aim") / 100 * F.col("__total"), F.lit(0.0))).otherwise(F.lit(0.0))
    lacking = F.when(~cash, F.greatest(F.coalesce("target_weight", F.lit(0.0)) / 100 * F.col("__total") - F.col("current_value"), F.lit(0.0)))
    df = df.withColumn("__investable", investable).withColumn("deficit_value", lacking)
    deficits = F.sum("deficit_value").over(w)
    amount = F.when(cash, -F.col("__investable")).when((deficits > 0) & (F.col("__investable") > 0), F.col("deficit_value") / deficits * F.col("__investable")).otherwise(0.0)
    df = df.withColumn("buy_amount", amount).withColumn("weight_gap", F.coalesce("current_weight", F.lit(0.0)) - F.coalesce("target_weight", F.lit(0.0)))
    shares = F.when(~cash & (F.col("buy_amount") > 0) & (F.col("current_price") > 0), F.col("buy_amount") / F.col("current_price"))
    return df.withColumn("buy_shares", shares).drop("__total", "__cash", "__aim", "__investable")


def exposure(items: DataFrame, by: list[str], weight: str = "current_weight", keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """(keys, kind, name, weight): sums of weights by each column; an array column counts once for each element."""
    kinds = dict(items.dtypes)
    parts = []
    for c in by:
        names = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
        parts.append(items.select(*keys, F.lit(c).alias("kind"), F.explode(names).alias("name"), F.col(weight).alias("w")).where("name is not null"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys, "kind", "name").agg(F.sum("w").alias("weight"))
