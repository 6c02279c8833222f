"""Stored signal rules as relations: parsed from JSON columns, matched through an index of their conditions.

A rule's conditions are rows that feature aggregates meet by equality, once for all rules.
What a rule needs is counted, so neither a query's plan nor its expressions grow with the registry.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import if_small

#: The JSON of the three rule columns of a stored definition.
_CONDITION = "struct<featureKey:string,aggregate:string,operator:string,value:double,minObservedMetricCount:int>"
SELECTION = f"struct<default:boolean,all:array<{_CONDITION}>,any:array<{_CONDITION}>>"
EVIDENCE = "struct<supportingFeatureKeys:array<string>,contextFeatureKeys:array<string>,contradictingFeatureKeys:array<string>,maxPresentedItems:int>"
CONFIDENCE = "struct<minObservedMetricCount:int,fullConfidenceMetricCount:int>"
STORED = "model_key string, model_version string, factor string, axis string, signal_key string, signal_label string, priority int, selection_rules string, evidence_rules string, confidence_rules string, is_active boolean"
#: The key under which a rule without conditions is indexed; every entity of its scope has it.
ALWAYS = ""
SCOPE = ("factor", "axis")


@dataclass(frozen=True)
class Rules:
    """``definitions``: one row a rule. ``conditions``: one row for each condition, and one for a rule without any.
    ``rejected``: stored rows whose JSON can't be read, with the columns at fault."""

    definitions: DataFrame
    conditions: DataFrame
    rejected: DataFrame


def store(spark: SparkSession, signals: list, model_key: str = "factor_signal", model_version: str = "v0") -> DataFrame:
    """Definitions written down as stored rows: the rules as JSON text."""
    condition = lambda c: {"featureKey": c.feature_key, "aggregate": "latest_median", "operator": c.operator, "value": c.value, "minObservedMetricCount": c.least_metrics}
    rows = []
    for s in signals:
        selection = {"default": True} if s.default else {k: [condition(c) for c in v] for k, v in (("all", s.all), ("any", s.any)) if v}
        evidence = {"supportingFeatureKeys": list(s.supporting), "contradictingFeatureKeys": list(s.contradicting), "maxPresentedItems": s.max_items}
        confidence = {"minObservedMetricCount": s.least_metrics} | ({"fullConfidenceMetricCount": s.full_metrics} if s.full_metrics else {})
        label = s.signal_key.replace("_", " ").title()
        rows.append((model_key, model_version, s.factor, s.axis, s.signal_key, label, s.priority, json.dumps(selection), json.dumps(evidence), json.dumps(confidence), True))
    return spark.createDataFrame(rows, STORED)


def read(stored: DataFrame, model_key: str = "factor_signal", model_version: str = "v0") -> Rules:
    """The active rules of one model. A row with a rule column that is null, no JSON object or of other types is rejected.

    Of rows that repeat a scope and key the first by priority and label counts. Unknown operators never hold; keys that aren't
    known are ignored.
    """
    own = stored.where((F.col("model_key") == model_key) & (F.col("model_version") == model_version) & F.col("is_active"))
    columns = {"selection_rules": SELECTION, "evidence_rules": EVIDENCE, "confidence_rules": CONFIDENCE}
    parsed = own
    for name, kind in columns.items():
        parsed = parsed.withColumn(f"__{name}", F.from_json(name, F.lit(f"{kind[:-1]},__bad:string>"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    faulty = F.filter(F.array(*[F.when(F.col(f"__{n}").isNull() | F.col(f"__{n}.__bad").isNotNull(), F.lit(n)) for n in columns]), lambda n: n.isNotNull())
    parsed = parsed.withColumn("faults", faulty)
    rejected = parsed.where(F.size("faults") > 0).select(*stored.columns, "faults")
    none = F.array().cast("array<string>")
    s, e, c = F.col("__selection_rules"), F.col("__evidence_rules"), F.col("__confidence_rules")
    conditions = lambda clause: F.coalesce(F.transform(s[clause], lambda x: F.struct(F.lit(clause).alias("clause"), x.alias("c"))), F.array().cast(f"array<struct<clause:string,c:{_CONDITION}>>"))
    default = F.coalesce(s["default"], F.lit(False))
    every = F.when(default, F.array().cast(f"array<struct<clause:string,c:{_CONDITION}>>")).otherwise(F.concat(conditions("all"), conditions("any")))
    least = F.coalesce(c["minObservedMetricCount"], F.lit(1))
    told = parsed.where(F.size("faults") == 0).select(
        *SCOPE, "signal_key", "signal_label", F.coalesce("priority", F.lit(100)).alias("priority"), default.alias("is_default"), every.alias("__c"),
        F.concat(F.coalesce(e["supportingFeatureKeys"], none), F.coalesce(e["contextFeatureKeys"], none)).alias("supporting"),
        F.coalesce(e["contradictingFeatureKeys"], none).alias("contradicting"), F.coalesce(e["maxPresentedItems"], F.lit(5)).alias("max_items"),
        least.alias("least_metrics"), F.coalesce(c["fullConfidenceMetricCount"], least).alias("full_metrics"),
    )
    first = Window.partitionBy(*SCOPE, "signal_key").orderBy("priority", "signal_label")
    told = told.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    told = told.withColumns({
        "n_all": F.size(F.filter("__c", lambda x: x["clause"] == "all")), "n_any": F.size(F.filter("__c", lambda x: x["clause"] == "any")),
        # what is shown for a rule whose conditions name no feature that held
        "named_first": F.get("__c", F.lit(0))["c"]["featureKey"],
    })
    indexed = told.select(*SCOPE, "signal_key", "priority", "n_all", "n_any", "is_default", F.posexplode_outer("__c").alias("pos", "x")).select(
        *SCOPE, "signal_key", "priority", "n_all", "n_any", "is_default", "pos", F.col("x.clause").alias("clause"), F.coalesce("x.c.featureKey", F.lit(ALWAYS)).alias("feature_key"),
        F.col("x.c.operator").alias("operator"), F.col("x.c.value").alias("threshold"), F.coalesce("x.c.minObservedMetricCount", F.lit(1)).alias("least"),
    )
    return Rules(told.drop("__c"), indexed, rejected)


def holds(value: Column, metrics: Column) -> Column:
    """Whether the condition of the row holds for an aggregate."""
    operator, threshold = F.col("operator"), F.col("threshold")
    compared = (
        F.when(operator == ">=", value >= threshold).when(operator == ">", value > threshold).when(operator == "<=", value <= threshold)
        .when(operator == "<", value < threshold).when(operator == "=", value == threshold)
    )
    return F.coalesce((metrics >= F.col("least")) & compared, F.lit(False))


def matches(aggregates: DataFrame, rules: Rules, keys: list[str]) -> DataFrame:
    """For each group of ``keys`` (an entity, its scope, maybe a point in time) and rule of the scope that any of its
    features is named by: whether the rule matches, and by which feature.

    ``aggregates``: one row for each group and feature, with value and metrics. Returned: keys, signal_key, priority,
    matched, unconditional, by_feature (the first alternative that holds), distance (the least of |value - threshold| /
    max(|threshold|, 1)) and driver (the value of the feature named first).
    """
    always = F.array(F.struct("feature_key", "value", "metrics"), F.struct(F.lit(ALWAYS).alias("feature_key"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("metrics")))
    offered = aggregates.select(*keys, F.explode(always).alias("f")).select(*keys, "f.*")
    met = offered.join(if_small(rules.conditions), [*SCOPE, "feature_key"])
    met = met.withColumn("ok", holds(F.col("value"), F.col("metrics")))
    told = met.groupBy(*keys, "signal_key", "priority", "n_all", "n_any", "is_default").agg(
        # a condition meets one row, that of its feature
        F.count_if(F.col("ok") & (F.col("clause") == "all")).alias("all_ok"), F.count_if(F.col("ok") & (F.col("clause") == "any")).alias("n_any_ok"),
        F.min(F.when(F.col("ok") & (F.col("clause") == "any"), F.struct("pos", "feature_key"))).alias("any_ok"),
        F.min(F.abs(F.col("value") - F.col("threshold")) / F.greatest(F.abs("threshold"), F.lit(1.0))).alias("distance"),
        F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("driver"),
    )
    return told.select(
        *keys, "signal_key", "priority", ((F.col("all_ok") == F.col("n_all")) & ((F.col("n_any") == 0) | (F.col("n_any_ok") > 0))).alias("matched"),
        ((F.col("n_all") + F.col("n_any") == 0) & ~F.col("is_default")).alias("unconditional"), F.col("any_ok.feature_key").alias("by_feature"), "distance", "driver",
    )
