"""Signals as they are stored: evidence and feature values as JSON text, and read back item by item.

What was written by another version, or by hand, is read as far as it goes: an item that lacks a field or has one of
another type is dropped and counted, keys that aren't known are ignored, and text that isn't such JSON is kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a stored item, of which all but the number are text, and of a stored feature value.
ITEM = {"metric_key": "metricKey", "feature_key": "featureKey", "feature_value": "featureValue", "period_end": "periodEnd", "effective_date": "effectiveDate"}
VALUE, COUNT = "value", "observedMetricCount"
SIDES = {"supporting": "supporting_evidence", "contradicting": "contradicting_evidence"}
KEYS = ["entity", "ticker", "cik", "factor", "axis", "signal_key", "signal_value", "confidence", "primary_feature_key", "observed_metrics", "total_metrics", "period_end", "effective_date"]


def stored(signals: DataFrame) -> DataFrame:
    """Signals of :func:`signals.build` with their evidence and feature values as JSON text."""
    items = lambda c: F.to_json(F.transform(c, lambda x: F.struct(*[x[own].alias(name) for own, name in ITEM.items()])))
    pairs = F.transform(F.map_entries("feature_values"), lambda e: F.struct(e["key"], F.struct(e["value"].alias(VALUE), F.col("feature_metrics")[e["key"]].alias(COUNT))))
    return signals.select(*KEYS, F.to_json(F.map_from_entries(pairs)).alias("feature_values"), *[items(F.col(c)).alias(name) for c, name in SIDES.items()])


def _number(v: Column, key: str) -> Column:
    """A finite number, or a text that is one."""
    n = F.try_variant_get(v, f"$.{key}", "double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def _text(v: Column, key: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored signals with arrays and a map again, and ``dropped_items``; and what couldn't be read: (entity, factor, axis, column, text).

    A column that is null, no JSON, or JSON of another shape reads as empty. Days that are no dates are null.
    """
    parsed = rows.withColumns({f"__{c}": F.try_parse_json(c) for c in ("feature_values", *SIDES.values())})
    told = parsed.withColumns({f"__{c}": F.try_variant_get(f"__{c}", "$", "array<variant>") for c in SIDES.values()})
    told = told.withColumn("__feature_values", F.try_variant_get("__feature_values", "$", "map<string,variant>"))
    faulty = F.filter(F.array(*[F.when(F.col(c).isNotNull() & F.col(f"__{c}").isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text"))) for c in ("feature_values", *SIDES.values())]), lambda x: x.isNotNull())
    rejected = told.withColumn("f", F.explode(faulty)).select("entity", "factor", "axis", "f.*")

    def items(c: str) -> Column:
        each = F.transform(f"__{c}", lambda v: F.struct(*[(_number(v, name) if own == "feature_value" else _text(v, name)).alias(own) for own, name in ITEM.items()]))
        whole = F.filter(each, lambda x: F.forall(F.array(*[x[own].isNotNull() for own in ITEM]), lambda ok: ok))
        days = lambda x: F.struct(*[(x[own].try_cast("date") if own in ("period_end", "effective_date") else x[own]).alias(own) for own in ITEM])
        return F.coalesce(F.transform(whole, days), F.array().cast("array<struct<metric_key:string,feature_key:string,feature_value:double,period_end:date,effective_date:date>>"))

    value = F.transform_values("__feature_values", lambda _, v: F.struct(_number(v, VALUE).alias("value"), _number(v, COUNT).cast("long").alias("metrics")))
    values = F.coalesce(F.map_filter(value, lambda _, v: v["value"].isNotNull() & v["metrics"].isNotNull()), F.create_map().cast("map<string,struct<value:double,metrics:bigint>>"))
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    told = told.withColumns({side: items(c) for side, c in SIDES.items()}).withColumn("values", values)
    dropped = sum((size(f"__{c}") - F.size(side) for side, c in SIDES.items()), F.lit(0)) + size(F.map_keys("__feature_values")) - F.size(F.map_keys("values"))
    return told.select(*[c for c in KEYS if c in rows.columns], F.col("values").alias("feature_values"), *SIDES, dropped.alias("dropped_items")), rejected
