"""Stored fiscal profiles, the sector gate, the comparison of series, and the macro series of metrics, on small rows."""

import datetime as dt
import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, fiscal, fiscal_store, metric_series
from tidemark.sources import facts

FACT = "cik string, fy int, fp string, form string, frame string, start date, end date, filed date, accn string"


def d(text):
    return dt.date.fromisoformat(text)


def filed(cik, years, first=(1, 1), end=(12, 31)):
    rows = []
    for y in years:
        start, last = dt.date(y, *first), dt.date(y, *end)
        rows.append((cik, y, "FY", "10-K", None, start, last, last + dt.timedelta(60), f"{cik}-{y}"))
        rows += [(cik, y, f"Q{q}", "10-Q", None, dt.date(y, 3 * q - 2, 1), dt.date(y, 3 * q, (31, 30, 30)[q - 1]), last, f"{cik}-{y}-{q}") for q in (1, 2, 3)]
    return rows


@pytest.fixture()
def store(spark, tmp_path):
    return fiscal_store.ProfileStore(spark, f"file://{tmp_path}/profiles", 8)


def windows(pair):
    years, quarters = pair
    return sorted(tuple(r) for r in years.select("cik", "fiscal_year", "low", "high", "exact").collect()), sorted(tuple(r) for r in quarters.select("cik", "fiscal_year", "fiscal_quarter", "low", "high").collect())


def test_profiles_come_back_and_only_changed_companies_are_written(spark, store, tmp_path):
    parts = lambda: set(glob.glob(f"{tmp_path}/profiles/bucket=*/*.parquet"))
    table = lambda rows: spark.createDataFrame(rows, FACT)
    old = filed("a", (2018, 2019, 2020)) + filed("b", (2019, 2021)) + filed("c", (2020,))
    assert store.rows().count() == 0 and windows(store.calendar()) == ([], [])
    assert store.update(fiscal_store.profile(table(old))) == 3
    assert windows(store.calendar()) == windows(fiscal.calendar(table(old)))
    before = parts()
    assert store.update(fiscal_store.profile(table(old[::-1]))) == 0 and parts() == before
    new = filed("b", (2019, 2021, 2022)) + filed("d", (2022,))
    assert store.update(fiscal_store.profile(table(new))) == 2
    assert windows(store.calendar()) == windows(fiscal.calendar(table([r for r in old if r[0] != "b"] + new)))
    assert before & parts(), "partitions of other companies are left alone"
    assert [r.cik for r in store.rows(["b"]).collect()] == ["b"] and store.rows([]).count() == 0 and store.rows(["none"]).count() == 0
    assert re.search(r"PartitionFilters: \[[^]]*bucket", store.rows(["b"])._jdf.queryExecution().executedPlan().toString())
    assert store.update(fiscal_store.profile(table(old)).where("false")) == 0


def test_a_company_without_quarters_has_empty_arrays(spark, store):
    year = [r for r in filed("a", (2020,)) if r[2] == "FY"]
    store.update(fiscal_store.profile(spark.createDataFrame(year, FACT)))
    (row,) = store.rows().collect()
    assert row.quarter_periods == [] and row.quarter_lengths == [] and len(row.annual_periods) == 1 and json.loads(row.regimes)[0]["kind"] == "calendar_month_end"


def test_regimes_that_cannot_be_read_are_told(spark):
    good = {"regime": 1, "start_year": 2001, "end_year": None, "end_month": 12, "end_day": 31, "kind": "transition", "confidence": 0.5, "transition_years": [2001], "extra": {"x": 1}}
    texts = [("a", json.dumps([good, {**good, "kind": "other"}, {"kind": "transition"}, 7, None])), ("b", "[]"), ("c", None), ("d", "{"), ("e", json.dumps(good)), ("f", ""), ("g", json.dumps([{**good, "start_year": "soon"}]))]
    told, rejected = fiscal_store.regimes(spark.createDataFrame(texts, "cik string, regimes string"))
    (row,) = told.collect()
    assert (row.cik, row.start_year, row.end_year, row.transition_years, row.usual_days) == ("a", 2001, None, [2001], None)
    assert sorted(r.cik for r in rejected.collect()) == ["d", "e", "f"]


def test_sector_gate(spark):
    registry = [("any", True, None, None), ("none", False, ["x"], None), ("unset", None, None, None), ("only", True, ["x", "y"], ["x"]), ("but", True, [], ["x"])]
    companies = spark.createDataFrame([("1", " x "), ("2", "y"), ("3", ""), ("4", None)], "cik string, sector string")
    mapped = spark.createDataFrame([(c, *r) for c in "12345" for r in registry], "cik string, tag string, enabled boolean, include_sectors array<string>, exclude_sectors array<string>")
    told = facts.gate_by_sector(mapped, companies)
    assert told.columns == ["cik", "tag"]
    kept = sorted((r.cik, r.tag) for r in told.collect())
    assert kept == sorted([*((c, "any") for c in "12345"), ("1", "only"), ("2", "only"), *((c, "but") for c in "2345")])
    assert facts.gate_by_sector(mapped.where("false"), companies).count() == 0


def test_comparison_of_series(spark):
    schema = "cik string, metric_key string, unit string, period_type string, fiscal_year int, fiscal_quarter int, end date, val double, source_tag string"
    row = lambda year, quarter, val, tag, end="2020-12-31": ("a", "m", "USD", "quarter" if quarter else "annual", year, quarter, d(end), val, tag)
    snap = lambda end, val: ("a", "s", "USD", "instant", 2020, None, d(end), val, "t")
    base = [row(2020, None, 1.0, "t"), row(2020, 1, 2.0, "t"), row(2020, 2, 3.0, "t"), snap("2020-03-31", 1.0)]
    wide = [row(2020, None, 1.0, "t", "2020-12-30"), row(2020, 1, 2.5, "u"), row(2021, 1, 9.0, "u"), snap("2020-03-31", 1.0), snap("2020-06-30", 1.0)]
    told = {r.metric_key: tuple(r)[2:] for r in metric_series.compare(spark.createDataFrame(base, schema), spark.createDataFrame(wide, schema)).collect()}
    assert told == {"m": (3, 3, 1, 1, 1, ["t", "u"]), "s": (1, 2, 1, 0, 0, ["t"])}


def test_macros_of_metrics(spark):
    rows = spark.createDataFrame([("revenue",), ("unknown",), (None,), ("capex_cash",)], "m string")
    told = {r.m: list(r.k) for r in rows.select("m", features.macros_of(F.col("m")).alias("k")).collect()}
    assert told["unknown"] == told[None] == list(features.DEFAULT_MACROS) and told["revenue"][2] == "pce_inflation_yoy" and len(told["capex_cash"]) == 2
    assert [list(r.k) for r in rows.limit(1).select(features.macros_of(F.col("m"), {}, ()).alias("k")).collect()] == [[]]
    value = ("1", "T", "1", "f", "a", "revenue", "k", 0.5, d("2020-06-30"), d("2020-07-30"))
    known = spark.createDataFrame([value], "entity string, ticker string, cik string, factor string, axis string, metric_key string, feature_key string, feature_value double, period_end date, effective_date date")
    macro = spark.createDataFrame([("x", d("2020-06-01"), 10.0), ("x", d("2020-07-01"), 99.0), ("z", d("2020-01-01"), 5.0)], "series_id string, observation_date date, value double")
    got = features.mapped_macros(known, macro, {"revenue": ("x", "y")}, ("z",)).orderBy("place").collect()
    assert [(r.place, r.series_id, r.macro_value, r.contrast) for r in got] == [(1, "x", 10.0, 0.4), (2, "y", None, None)]
