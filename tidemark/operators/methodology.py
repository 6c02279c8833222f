"""Registries as trees: every factor with its axes, features, metrics and signals, nested from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import if_small


def _label(labels: dict[str, str], factor: Column, key: Column | None = None) -> Column:
    """The display name that the map has for a factor, or for a key of it; else the key itself."""
    name = factor if key is None else F.concat_ws(".", factor, key)
    plain = factor if key is None else key
    if not labels:
        return plain
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(known[name], plain)


def _gather(rows: DataFrame, keys: list[str], name: str, order: list[str], shown: list[str]) -> DataFrame:
    """One row a group: the ``shown`` columns of its rows as an array of structs, in ``order``."""
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*shown).alias("row"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["row"]).alias(name))


def registry_tree(features: DataFrame, signals: DataFrame, observed: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(factor, label, axes): axes hold features (their metrics with the number of companies that have a value) and signals by priority.

    ``features`` (factor, axis, metric_key, feature_key) and ``signals`` (factor, axis, signal_key, priority) are definitions;
    ``observed`` the feature table. A level is gathered before the next is put on it, so each aggregate is as small as its
    registry. ``labels``: display names of ``factor`` or ``factor.key`` that stand instead of the keys. Factors or axes that only
    one of the two registries names are there too.
    """
    labels = labels or {}
    keys = ["factor", "axis", "feature_key", "metric_key"]
    counted = observed.groupBy(*keys).agg(F.count_distinct("cik").alias("companies"))
    metrics = features.select(*keys).distinct().join(if_small(counted), keys, "left").withColumn("companies", F.coalesce("companies", F.lit(0)))
    by_feature = _gather(metrics, keys[:3], "metrics", ["metric_key"], ["metric_key", "companies"]).withColumn("label", _label(labels, F.col("factor"), F.col("feature_key")))
    by_axis = _gather(by_feature, keys[:2], "features", ["feature_key"], ["feature_key", "label", "metrics"])
    states = signals.select("factor", "axis", "signal_key", _label(labels, F.col("factor"), F.col("signal_key")).alias("label"), "priority")
    stated = _gather(states, keys[:2], "signals", ["priority", "signal_key"], ["signal_key", "label", "priority"])
    both = by_axis.join(stated, keys[:2], "full")
    empty = lambda name: F.coalesce(name, F.array().cast(both.schema[name].dataType)).alias(name)
    axes = both.select("factor", "axis", empty("features"), empty("signals"))
    told = _gather(axes, ["factor"], "axes", ["axis"], ["axis", "features", "signals"])
    return told.select("factor", _label(labels, F.col("factor")).alias("label"), "axes")
