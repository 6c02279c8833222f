"""Snapshots keyed by scope and date against one at a time by brute force, and their store."""

import datetime as dt
import math
import os
import random

from pyspark.sql import functions as F

from tidemark.operators import signals, snapshots

DAYS = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30)]
SIGNALS = "as_of date, entity string, factor string, axis string, signal_key string"


def rows(seed=1, n=40):
    rng = random.Random(seed)
    told = []
    for day in DAYS:
        for e in range(n):
            for f in "abcdef":
                if rng.random() < 0.85:
                    axis = "market_price" if f in "ef" else "fundamentals_based"
                    told.append((day, f"E{e}", f, axis, rng.choice((f"mixed_{f}", f"{f}_up", f"{f}_up", f"{f}_down"))))
    return told


def brute(signals, threshold):
    states = {}
    for _, e, f, x, k in signals:
        states.setdefault(e, set()).add((f, x, k))
    groups = {}
    for s in states.values():
        key = tuple(sorted(f"{f}.{x}={k}" for f, x, k in s))
        groups.setdefault(key, [0, {f"{f}.{x}.{k}" for f, x, k in s if not k.startswith("mixed_")}])[0] += 1
    order = sorted(groups, key=lambda k: (-groups[k][0], "|".join(k)))
    df = {}
    for k in order:
        for t in groups[k][1]:
            df[t] = df.get(t, 0) + 1
    w = {t: min(math.log(1 + len(order) / n), 3.0) for t, n in df.items()}
    pairs = {}
    for i, k in enumerate(order):
        for j, m in enumerate(order[:i]):
            x, y = groups[k][1], groups[m][1]
            if x & y:
                pairs[j, i] = sum(w[t] for t in x & y) / sum(w[t] for t in x | y)
    label = list(range(len(order)))
    for _ in order:
        for (a, b), v in pairs.items():
            if v >= threshold:
                label[a] = label[b] = min(label[a], label[b])
    families = {}
    for i, v in enumerate(label):
        families.setdefault(v, []).append(i)
    top = min(families, key=lambda v: (-len(families[v]), v))
    sizes = [groups[k][0] for k in order]
    held = {}
    for i in families[top]:
        for t in groups[order[i]][1]:
            n, g = held.get(t, (0, 0))
            held[t] = n + sizes[i], g + 1
    inside = sum(sizes[i] for i in families[top])
    core = [(t, round(held[t][0] / inside, 6)) for t in sorted(held, key=lambda t: (-held[t][0], -held[t][1], t))[:5]]
    return (len(states), len(order), len(df), len(families), len(families[top]), inside, core), {p: round(v, 9) for p, v in pairs.items()}


def test_all_snapshots_in_one_job_equal_each_alone(spark):
    told = rows()
    at = snapshots.scoped(spark.createDataFrame(told, SIGNALS))
    got = {(r["scope"], r["as_of"]): (*(r[c] for c in ("entities", "groups", "dimensions", "families", "largest_groups", "largest_entities")), [(c["token"], round(c["share"], 6)) for c in r["core"]]) for r in snapshots.snapshot_rows(at, 0.55).collect()}
    assert len(got) == 9
    for (scope, day), row in got.items():
        axes = snapshots.SCOPES[scope]
        assert row == brute([s for s in told if s[0] == day and (axes is None or s[3] in axes)], 0.55)[0], (scope, day)


def test_similar_pairs_are_all_and_only_those(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "GROUPS_A_TASK", 7)
    told = rows(4, 60)
    found = snapshots.weighted_tokens(snapshots.state_groups(snapshots.scoped(spark.createDataFrame(told, SIGNALS), {"all": None}))).cache()
    want = {day: brute([s for s in told if s[0] == day], 0.5)[1] for day in DAYS}
    for least in (0.3, 0.6, 0.95):
        got = {(r["as_of"], r["a"], r["b"]): r["weight"] for r in snapshots.similar_pairs(found, least).collect()}
        expected = {(d, a, b): v for d, p in want.items() for (a, b), v in p.items() if v >= least}
        assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-8 for k, v in expected.items())


def test_store_builds_only_what_is_missing_or_changed(spark, tmp_path):
    told = rows(2, 15)
    at = lambda some: snapshots.scoped(spark.createDataFrame(some, SIGNALS))
    folder = f"{tmp_path}/s"
    store = snapshots.SnapshotStore(spark, f"file://{folder}", 0.5)
    assert store.rows().count() == 0
    assert store.update(at([s for s in told if s[0] < DAYS[2]])) == 6 and store.update(at([s for s in told if s[0] < DAYS[2]])) == 0
    assert store.update(at(told)) == 3 and store.update(at(list(reversed(told)))) == 0 and store.rows().count() == 9
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}
    before = files()
    changed = [(d, e, f, x, "a_down" if (d, e, f) == (DAYS[1], "E3", "a") else k) for d, e, f, x, k in told]
    changed = changed if changed != told else [*told, (DAYS[1], "E99", "a", "fundamentals_based", "a_up")]
    assert store.update(at(changed)) == 2
    gone = {f.split(folder)[1].split("/part")[0] for f in before - files()}
    assert gone == {"/scope=all/as_of=2020-06-30", "/scope=fundamentals/as_of=2020-06-30"}
    whole = snapshots.snapshot_rows(at(changed), 0.5)
    show = lambda df: sorted(str(tuple(r)) for r in df.select("scope", "as_of", "entities", "groups", "families", "core").collect())
    assert show(store.rows()) == show(whole)
    # another threshold is another table of marks: everything is built anew
    assert snapshots.SnapshotStore(spark, f"file://{folder}", 0.7).update(at(changed)) == 9
    assert store.update(at([])) == 0


def test_questions_are_gated_by_their_policies(spark):
    told = spark.createDataFrame(rows(3, 5), SIGNALS)
    policies = spark.createDataFrame([("a", "fundamentals_based", "use", True), ("b", "fundamentals_based", "review", True), ("c", "fundamentals_based", "hold", True), ("d", "fundamentals_based", "use", False), ("e", "elsewhere", "use", True), ("a", "fundamentals_based", "use", True)], "factor string, axis string, status string, is_active boolean")
    kept = snapshots.gated(told, policies)
    assert {r["factor"] for r in kept.select("factor").distinct().collect()} == {"a", "b"} and kept.count() == told.where(F.col("factor").isin("a", "b")).count()


def test_states_are_hashed_and_cut_alike_for_few_and_many_dates(spark):
    day = lambda m: dt.date(2000, m, 1)
    rows = [("A", "1", "g", "x", metric, "yoy", value, day(m), day(m)) for metric, value, m in (("r", 1.0, 1), ("n", -3.0, 2), ("r", 5.0, 4), ("o", 0.5, 5), ("n", -9.0, 7))]
    rows += [("B", "2", "g", "x", "r", "yoy", -1.0, day(3), day(3)), ("B", "2", "g", "x", "r", "yoy", None, day(6), day(6)), ("C", "3", "g", "x", "r", "other", 1.0, day(1), None)]
    features = spark.createDataFrame(rows, "ticker string, cik string, factor string, axis string, metric_key string, feature_key string, feature_value double, period_end date, effective_date date")
    registry = signals.Registry([
        signals.Signal("g", "x", "up", 1, all=(signals.Condition("yoy", ">", 0.5),)), signals.Signal("g", "x", "down", 1, all=(signals.Condition("yoy", "<", 0.0),)), signals.Signal("g", "x", "none", 9, default=True),
    ])
    few = [f"2000-{m:02d}-15" for m in range(1, 9)]
    told = signals.states(features, registry, few)
    assert "SortAggregate" not in told._jdf.queryExecution().executedPlan().toString()
    seen = {(r.entity, r.as_of.month): r.signal_key for r in told.collect()}
    # the medians of A: 1, -1, -1, 1, 0.5, 0.5, 0.5, 0.5
    assert [seen["1", m] for m in range(1, 9)] == ["up", "down", "down", "up", "none", "none", "none", "none"]
    assert [seen.get(("2", m)) for m in range(1, 9)] == [None, None, *["down"] * 6] and {seen["3", m] for m in range(1, 9)} == {"none"}
    many = signals.states(features, registry, few + [f"{y}-06-30" for y in range(2100, 2160)])
    assert {(r.entity, r.as_of.month): r.signal_key for r in many.collect() if r.as_of.year == 2000} == seen
