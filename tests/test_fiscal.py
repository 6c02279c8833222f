"""Fiscal calendars and metric series on small hand-made filings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, fiscal, metric_series, periods

SCHEMA = "cik string, tag string, metric_key string, fact_type string, unit string, priority int, start date, end date, val double, filed date, accn string, fy int, fp string, form string, frame string"


def d(text):
    return dt.date.fromisoformat(text) if text else None


def row(metric, start, end, val, fp, form="10-Q", filed=None, fy=2022, kind="flow", tag=None, accn="a"):
    return ("c", tag or metric, metric, kind, "USD", 1, d(start), d(end), val, d(filed or "2023-02-01"), accn, fy, fp, form, None)


@pytest.fixture(scope="module")
def filings(spark):
    rows = [
        row("revenue", "2022-01-01", "2022-03-31", 100.0, "Q1"), row("revenue", "2022-01-01", "2022-06-30", 250.0, "Q2"), row("revenue", "2022-01-01", "2022-09-30", 330.0, "Q3"),
        row("revenue", "2022-01-01", "2022-12-31", 400.0, "FY", "10-K"), row("revenue", "2022-01-01", "2022-12-31", 410.0, "FY", "10-K", "2024-02-01", accn="b"),
        row("revenue", "2023-01-01", "2023-03-31", 100.0, "Q1", fy=2023), row("revenue", "2023-01-01", "2023-06-30", 90.0, "Q2", fy=2023), row("revenue", "2023-01-01", "2023-12-31", 500.0, "FY", "10-K", "2024-02-01", fy=2023),
        *[row("net_income", *span, v, q) for span, v, q in ((("2022-01-01", "2022-03-31"), 1.0, "Q1"), (("2022-04-01", "2022-06-30"), 2.0, "Q2"), (("2022-07-01", "2022-09-30"), 3.0, "Q3"), (("2022-10-01", "2022-12-31"), 4.0, "Q4"))],
        row("capex_cash", "2022-04-01", "2022-05-15", 7.0, None, "8-K", fy=None), row("capex_cash", "2022-05-16", "2022-06-30", 8.0, None, "8-K", fy=None), row("capex_cash", "2022-07-01", "2022-08-01", 9.0, None, "8-K", fy=None),
        row("dividends", "2022-07-01", "2022-08-14", 5.0, "Q3"), row("dividends", "2022-08-15", "2022-09-30", 6.0, "Q3"),
        row("assets", None, "2022-12-31", 50.0, "FY", "10-K", kind="instant"), row("assets", None, "2022-12-31", 55.0, "FY", "10-K", "2023-05-01", kind="instant"), row("assets", None, None, 1.0, "FY", kind="instant"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_calendar(filings):
    annual = fiscal.annual_periods(filings)
    assert [(r.fiscal_year, str(r.end), r.is_anchor, str(r.filed)) for r in annual.orderBy("fiscal_year").collect()] == [(2022, "2022-12-31", False, "2024-02-01"), (2023, "2023-12-31", True, "2024-02-01")]
    told = {(r.fiscal_year, r.fiscal_quarter): (str(r.start), str(r.end), r.source) for r in fiscal.quarter_periods(annual, fiscal.quarter_candidates(filings)).collect()}
    assert told[2022, 2] == ("2022-04-01", "2022-06-30", "direct") and told[2022, 4] == ("2022-10-01", "2022-12-31", "direct")
    assert told[2023, 2] == ("2023-04-01", "2023-06-30", "cumulative_derived") and (2023, 3) not in told
    (run,) = fiscal.regime_history(annual).collect()
    assert (run.kind, run.start_year, run.end_year, run.usual_days, run.confidence) == ("calendar_month_end", 2022, None, 365, 0.75)


def test_built_series(filings):
    told = metric_series.build(filings, *fiscal.calendar(filings)).collect()
    value = {(r.metric_key, r.fiscal_year, r.fiscal_quarter): (r.val, r.source_kind) for r in told}
    assert value["revenue", 2022, None] == (410.0, "raw_direct") and value["revenue", 2022, 1] == (100.0, "raw_direct")
    assert value["revenue", 2022, 2] == (150.0, "cumulative_derived") and value["revenue", 2022, 3] == (80.0, "cumulative_derived")
    assert value["revenue", 2022, 4] == (80.0, "annual_derived")  # out of the restated year
    assert ("revenue", 2023, 2) not in value  # would be negative
    assert value["net_income", 2022, None] == (10.0, "annual_derived") and value["net_income", 2022, 4] == (4.0, "raw_direct")
    assert value["capex_cash", 2022, 2] == (15.0, "other_merged") and value["dividends", 2022, 3] == (11.0, "segment_merged")
    assert [r.val for r in told if r.metric_key == "assets"] == [55.0]
    assert all(r.effective_date is not None for r in told)


def test_derived_negatives_go_where_a_tag_is_known_as_positive(spark, filings):
    more = [row("capex_cash", "2023-01-01", "2023-03-31", 50.0, "Q1", fy=2023, tag="Capex"), row("capex_cash", "2023-01-01", "2023-06-30", 20.0, "Q2", fy=2023, tag="Capex"), row("capex_cash", "2023-01-01", "2023-09-30", 90.0, "Q3", fy=2023, tag="Capex")]
    rows, calendar = filings.unionByName(spark.createDataFrame(more, SCHEMA)), fiscal.calendar(filings)
    value = lambda positive: {r.fiscal_quarter: r.val for r in metric_series.build(rows, *calendar, positive).where("metric_key = 'capex_cash' and fiscal_year = 2023").collect()}
    known = spark.createDataFrame([("c", "capex_cash", "Capex", "USD")] * 2, "cik string, metric_key string, tag string, unit string")
    assert value(None) == {1: 50.0, 2: -30.0, 3: 70.0} and value(known) == {1: 50.0, 3: 70.0}
    assert value(known.withColumn("tag", F.lit("Other"))) == value(None)


def test_periods_are_chosen_without_sorting_candidates(spark):
    schema = "cik string, start date, end date, fy int, fp string, form string, frame string"
    rows = [
        ("c", d("2022-01-01"), d("2022-12-31"), 2022, "FY", "10-K", None), ("c", d("2022-01-01"), d("2022-12-31"), None, None, None, "CY2022"), ("c", d("2022-04-03"), d("2022-06-30"), 2022, "Q2", "10-Q", None),
        ("c", d("2022-01-01"), d("2022-06-30"), 2022, "Q2", "10-Q", None), ("c", None, d("2022-09-28"), 2022, "Q3", "10-Q", None), ("c", d("2022-05-01"), d("2022-05-31"), 2022, "Q2", "10-Q", None),
        ("c", None, None, None, None, None, None), ("d", d("2022-01-01"), d("2022-03-31"), 2022, "Q1", "10-Q", None), (None, d("2022-01-01"), d("2022-03-31"), None, None, None, None),
    ]
    years = spark.createDataFrame([("c", y, d(f"{y}-01-01"), d(f"{y}-12-31")) for y in (2021, 2022, 2023)], "cik string, fiscal_year int, low date, high date")
    told = periods.resolve_periods(spark.createDataFrame(rows + rows[:1], schema), years, periods.quarter_windows(years, (90, 91, 92)))
    # the windows that a span could be of are compared in place, by one number each
    assert "SortAggregate" not in told._jdf.queryExecution().executedPlan().toString()
    seen = [(str(r.cik), str(r.start), str(r.end), r.kind, r.fiscal_year, r.fiscal_quarter, r.window_match, r.basis) for r in told.collect()]
    assert sorted(seen, key=str) == sorted([
        *[("c", "2022-01-01", "2022-12-31", "annual", 2022, None, "exact", "annual_window")] * 3, ("c", "2022-04-03", "2022-06-30", "quarter", 2022, 2, "near", "quarter_window"),
        ("c", "2022-01-01", "2022-06-30", "ytd", 2022, 2, "exact", "quarter_window"), ("c", "None", "2022-09-28", "instant", 2022, 3, "near", "fiscal_profile"), ("c", "2022-05-01", "2022-05-31", "other", 2022, None, "unknown", "unresolved"),
        ("c", "None", "None", "instant", None, None, "unknown", "instant_snapshot"), ("d", "2022-01-01", "2022-03-31", "quarter", 2022, 1, "exact", "sec_fp"), ("None", "2022-01-01", "2022-03-31", "other", None, None, "unknown", "unresolved"),
    ], key=str)


def test_a_part_of_resolved_facts_builds_its_series(filings):
    calendar = fiscal.calendar(filings)
    some = "metric_key in ('dividends', 'assets')"
    part = metric_series.build_resolved(metric_series.resolved(filings, *calendar).where(some), *calendar)
    assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, metric_series.build(filings.where(some), *calendar).collect()), key=str)


def test_calendar_without_facts(filings):
    none = filings.where("false")
    years, quarters = fiscal.calendar(none)
    assert years.count() == 0 and quarters.count() == 0 and metric_series.build(none, years, quarters).count() == 0


def test_mode_prefers_the_first(spark):
    made = spark.sql("select array(3, 5, 5, 3, 7) as x union all select array()")
    assert sorted([r[0] for r in made.select(fiscal.mode_of(F.col("x"))).collect()], key=str) == [3, None]


def test_vector_matrix(spark):
    rows = [("A", "x", 1.0), ("B", "x", 2.0), ("C", "x", 9.0), ("A", "y", -4.0), ("B", "y", 4.0), ("A", "z", 1.0), ("D", "z", None)]
    made = spark.createDataFrame(rows, "ticker string, feature_key string, feature_value double").withColumns({c: F.lit(c) for c in ("factor", "axis", "metric_key")})
    told = {r.ticker: r for r in features.vector_matrix(made, 0.6, 0.5, "sign").collect()}
    assert [k[-1] for k in told["A"].feature_keys] == ["x", "y"] and told["A"].values == [1.0, -1.0] and told["C"].values == [1.0, 0.0] and told["C"].missing == 1 and "D" not in told
    score = {r.ticker: r.values[0] for r in features.vector_matrix(made, 0.6).collect()}
    assert score["B"] == 0.0 and score["C"] == 3.0 and abs(score["A"] + 1 / 1.4826) < 1e-9
