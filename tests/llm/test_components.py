"""Components of edges, and how many jobs they and the near-duplicates take: the driver keeps something of every job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, neardup


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_stars_equal_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 30, 400):
        edges = [(rng.randrange(300) * 7 - 900, rng.randrange(300) * 7 - 900) for _ in range(n)]
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        want = {x: r for x, r in brute(edges).items() if x != r}
        assert dict(zip(*(v.tolist() for v in common.stars(a, b)), strict=True)) == want


@pytest.mark.parametrize("at_once", [3, 500_000])
def test_components_over_many_partitions(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "EDGES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)] + [(500, 500)]
    rng.shuffle(edges)
    table = spark.createDataFrame([*edges, (None, 4), (4, None)], "a int, b int").repartition(13)
    told = common.components(table).collect()
    assert {r["node"]: r["component"] for r in told} == brute([e for e in edges if e[0] != e[1]]) and len({r["node"] for r in told}) == len(told)
    assert common.components(table.where("a < 0")).count() == 0


def test_stars_take_no_round(spark):
    table = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).localCheckpoint()
    before = jobs(spark)
    assert common.components(table).agg(F.max("component")).first()[0] == 0
    assert jobs(spark) - before <= 10


def test_near_duplicates_take_few_jobs(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i % 3])) for i in range(12)] + [(20 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = jobs(spark)
    told = {r["doc_id"]: r["component_id"] for r in neardup.link(docs).collect()}
    assert told == {i: 0 if i < 12 else i for i, _ in rows}
    assert jobs(spark) - before <= 90


def tasks_of(spark, group, run):
    """What ``run`` returns, and how many tasks it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return found, sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_take_one_task(spark, many_partitions):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(4).shuffle(chain)
    table = spark.createDataFrame(chain, "a long, b long").repartition(7).localCheckpoint()
    told, tasks = tasks_of(spark, "chain", lambda: common.components(table).collect())
    assert {r["node"]: r["component"] for r in told} == dict.fromkeys(range(301), 0) and len(told) == 301
    assert tasks <= 30


def test_tasks_of_near_duplicates_follow_the_rows(spark, many_partitions):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        # edited again and again: what the first rounds join is joined further by later ones
        words = [f"v{i}" if rng.random() < 0.012 else w for w in words]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told, tasks = tasks_of(spark, "near-duplicates", lambda: neardup.link(docs).collect())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: i for i in sets} | brute(edges)
    assert len(edges) > 40 and {r["doc_id"]: r["component_id"] for r in told} == want
    # only what compares takes a task for each partition of its shuffle
    assert tasks <= 20 * 97
