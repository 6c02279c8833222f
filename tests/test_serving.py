"""Stored evidence, its faults, and the tables that serve overviews."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tests.test_operators import RULES, random_features
from tidemark.operators import evidence, serving, signals

D = dt.date


def test_evidence_goes_round(spark):
    built = signals.build(random_features(spark, 6), RULES).cache()
    rows, rejected = evidence.read(evidence.stored(built))
    names = ["entity", "factor", "signal_key", "supporting", "contradicting", "period_end"]
    show = lambda df: sorted(str(tuple(r)) for r in df.select(*names).collect())
    assert show(rows) == show(built) and rejected.count() == 0 and rows.where("dropped_items > 0").count() == 0
    own = {r["entity"]: {k: (v, r["feature_metrics"][k]) for k, v in r["feature_values"].items()} for r in built.collect()}
    assert own == {r["entity"]: {k: (v["value"], v["metrics"]) for k, v in r["feature_values"].items()} for r in rows.collect()}
    text = json.loads(evidence.stored(built).where(F.size(built["supporting"]) > 0).first()["supporting_evidence"])[0]
    assert set(text) == set(evidence.ITEM.values()) and isinstance(text["periodEnd"], str)


def test_faulty_evidence_is_kept_apart(spark):
    item = {"metricKey": "m", "featureKey": "f", "featureValue": 1.5, "periodEnd": "2020-01-31", "effectiveDate": "2020-02-29"}
    cases = [
        ([item, {**item, "more": [1]}, {**item, "featureValue": "2.5"}], 3, 0), ([item, {**item, "metricKey": 7}, {**item, "featureValue": "x"}, None, 5, []], 1, 5),
        ([{k: v for k, v in item.items() if k != "periodEnd"}], 0, 1), ([], 0, 0), ("{oops", 0, None), ({"a": 1}, 0, None), (None, 0, 0),
    ]
    names = evidence.KEYS
    kinds = ", ".join(f"{n} {'double' if n in ('signal_value', 'confidence') else 'int' if n.endswith('metrics') else 'date' if n in ('period_end', 'effective_date') else 'string'}" for n in names)
    base = lambda i: tuple(f"e{i}" if n == "entity" else None if "date" in n or n in ("period_end", "signal_value", "confidence") or n.endswith("metrics") else "x" for n in names)
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    values = '{"a": {"value": 1, "observedMetricCount": 2}, "b": {"value": null, "observedMetricCount": 1}, "c": 3}'
    frame = spark.createDataFrame([(*base(i), values if i == 0 else "{}", text(c), "[]") for i, (c, _, _) in enumerate(cases)], f"{kinds}, feature_values string, supporting_evidence string, contradicting_evidence string")
    rows, rejected = evidence.read(frame)
    told = {r["entity"]: r for r in rows.collect()}
    for i, (_, kept, dropped) in enumerate(cases):
        assert len(told[f"e{i}"]["supporting"]) == kept and told[f"e{i}"]["dropped_items"] == (dropped or 0) + (2 if i == 0 else 0), i
    assert told["e0"]["supporting"][2]["feature_value"] == 2.5 and told["e0"]["supporting"][0]["period_end"] == D(2020, 1, 31)
    assert {k: tuple(v) for k, v in told["e0"]["feature_values"].items()} == {"a": (1.0, 2)}
    assert sorted((r["entity"], r["column"]) for r in rejected.collect()) == [("e4", "supporting_evidence"), ("e5", "supporting_evidence")]


def test_overview_over_buckets_moves_nothing(spark, tmp_path):
    rows = random_features(spark, 9).where("cik is not null")
    built, _ = evidence.read(evidence.stored(signals.build(rows, RULES)))
    profiles = spark.createDataFrame([(str(i), f"T{i}", f"Company {i}") for i in range(1, 12)], "cik string, ticker string, company_name string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = serving.ServingTables(spark, f"file://{tmp_path}/serving", buckets=4).write(profiles=profiles, features=rows, signals=built)
    try:
        told = serving.overview(*(tables.table(n) for n in ("profiles", "features", "signals")))
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        plain = serving.overview(profiles, rows, built)
        show = lambda df: sorted(str(tuple(r)) for r in df.collect())
        assert show(told) == show(plain) and told.where(F.size("features") == 0).count() == 3
        one = tables.lookup("features", "3", metric_key="cash", feature_key=None)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        explained = spark._jvm.PythonSQLUtils.explainString(tables.lookup("features", "3")._jdf.queryExecution(), "formatted")
        assert "SelectedBucketsCount: 1 out of 4" in explained
        assert one.count() == rows.where("cik = '3' and metric_key = 'cash'").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        tables.drop()
    assert not tables.names
