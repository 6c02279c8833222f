"""The registered queries against their SQL on the smallest tables, and the driver's contract."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

import __spark_entry__ as driver  # noqa: E402
from tidemark.plans import fiscal_queries, general_queries, price_queries, series_queries, signal_queries, structure_queries  # noqa: E402

CHECKED = [n for m in (series_queries, general_queries, fiscal_queries) for n in m.SQL] + ["daily_returns", "series_features", "factor_signals", "valuation_composites", "pair_similarity", "threshold_sweep"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v).removesuffix(" 00:00:00")
    return f"{round(v, 4) + 0.0:.4f}"


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got = driver.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(want.columns) == names
    rows = lambda records: sorted(tuple(plain(r[n]) for n in names) for r in records)
    assert rows([r.asDict() for r in got.collect()]) == rows([dict(zip(want.columns, r)) for r in want.fetchall()])


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries()) and driver.entry(spark).columns[0] == "cik"
    own = {n for m in (series_queries, price_queries, signal_queries, structure_queries, general_queries, fiscal_queries) for n in m.QUERIES}
    assert own <= set(driver.queries()) and len(own) >= 70


def test_stream(spark, tmp_path):
    import shutil

    from tidemark.streaming import events

    shutil.copy(f"{SF}/events.parquet", tmp_path / "e.parquet")
    q = events.hourly(events.read_events(spark, str(tmp_path))).writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hourly").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
