"""States without evidence: the same as the timeline's, from one pass over the features."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import signals, snapshots
from tidemark.plans import signal_queries as sq
from tidemark.plans import structure_queries as tq
from tidemark.plans.registry import default_signals

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_states_are_those_of_the_timeline(spark):
    rows = sq._features(spark, SF).unionByName(tq._market_features(spark, SF))
    registry = default_signals(with_market=True)
    own = signals.states(rows, registry, sq.QUARTERS)
    whole = signals.timeline(rows, registry, sq.QUARTERS).select(own.columns)
    assert own.count() > 0 and sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.collect()))
    assert plan(own).count("RepartitionByExpression") == 1 < plan(whole).count("RepartitionByExpression")


def test_one_date_is_a_slice_of_all(spark):
    rows = sq._features(spark, SF).unionByName(tq._market_features(spark, SF))
    every = signals.states(rows, default_signals(with_market=True), sq.QUARTERS).where((F.col("as_of") == dt.date(2000, 12, 31)) & (F.col("axis") == sq.AXIS))
    one = signals.states(rows.where(F.col("axis") == sq.AXIS), default_signals(), ["2000-12-31"])
    assert one.count() > 0 and sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect()))


def test_gated_groups_build_one_date_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(tq, "_signals_at", lambda *a: asked.append(a))
    assert tq.gated_groups(spark, SF).count() > 0 and not asked


def test_aggregates_count_without_a_second_level(spark):
    each = signals.aggregates(sq._features(spark, SF))
    assert "distinct" not in plan(each.drop("all_metrics")).lower().replace("array_distinct", "")
    assert each.where(F.col("metrics") != F.size("all_metrics")).count() == 0


def test_snapshots_deal_entities_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(snapshots, "FEATURES_A_TASK", 100)
    monkeypatch.setattr(snapshots, "state_groups", lambda df, keys, f=snapshots.state_groups: seen.append(df.rdd.glom().map(len).max()) or f(df, keys))
    rows = spark.range(3000).selectExpr("'all' as scope", "date'2000-12-31' as as_of", "cast(id div 3 as string) as entity", "concat('f', id % 3) as factor", "'x' as axis", "concat('s', id % 2) as signal_key")
    told = snapshots.snapshot_rows(rows).collect()
    assert [(r["entities"], r["groups"]) for r in told] == [(1000, 2)] and seen and max(seen) < 200
