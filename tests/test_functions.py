"""Hand-derived cases of the scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import filings, numbers, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def d(s):
    return F.lit(s).cast("date")


def n(x):
    return F.lit(x).cast("double")


def test_null_arithmetic(spark):
    row = one(
        spark, numbers.growth(n(90), n(-100)), numbers.growth(n(-50), n(-100)), numbers.growth(n(5), n(0)), numbers.ratio(n(5), n(-1)), numbers.ratio_to_size(n(5), n(-2)),
        numbers.cagr(n(161.051), n(100), n(5)), numbers.mean_of([n(1), n(None), n(4)]), numbers.sum_nullable(n(None), n(2)), numbers.sum_nullable(n(None), n(None)),
        numbers.finite(n(float("nan"))), numbers.clamp01(n(3)), numbers.robust_z(n(None), n(0), n(1)), numbers.log_positive(n(-1)),
    )
    assert row[0] == pytest.approx(1.9) and row[1] == pytest.approx(0.5) and row[2] is None and row[3] is None and row[4] == pytest.approx(2.5)
    assert row[5] == pytest.approx(0.1) and row[6] == pytest.approx(2.5) and row[7] == 2 and row[8] is None and row[9] is None and row[10] == 1 and row[11] == 0 and row[12] is None


def test_entropy(spark):
    counts = lambda *c: F.array(*[n(x) for x in c])
    row = one(spark, numbers.normalized_entropy(counts(5, 5)), numbers.normalized_entropy(counts(7)), numbers.normalized_entropy(counts(3, 0)))
    assert row[0] == pytest.approx(1.0) and row[1] is None and row[2] is None


def test_dates(spark):
    row = one(
        spark, cal.add_months_overflow(d("2024-01-31"), 1), cal.add_months_overflow(d("2024-03-31"), 3), cal.previous_year_date(d("2024-02-29")), cal.duration_days(d("2024-01-01"), d("2024-03-31")),
        cal.weekday(d("2024-06-02")), cal.fiscal_year_of_end(d("2024-01-03")), cal.month_day_distance(d("2024-12-31"), d("2023-01-02")), cal.quarter_label(d("2024-08-01")),
        cal.snapshot_label(d("2024-09-30")), F.size(cal.snapshot_dates(d("2024-01-15"), d("2024-12-31"))), cal.previous_period_end(d("2024-05-07"), "quarter"),
    )
    assert row[0] == dt.date(2024, 3, 2) and row[1] == dt.date(2024, 7, 1) and row[2] is None and row[3] == 91 and row[4] == 0 and row[5] == 2023
    assert row[6] == 2 and row[7] == "24Q3" and row[8] == "2024 Q3" and row[9] == 4 and row[10] == dt.date(2024, 3, 31)


def test_holidays_and_market(spark):
    row = one(spark, cal.market_holidays(F.lit(2022)), cal.market_state(F.lit("2024-07-05 15:00:00").cast("timestamp")), cal.market_state(F.lit("2024-07-04 15:00:00").cast("timestamp")), cal.market_state(F.lit("2024-07-06 15:00:00").cast("timestamp")))
    assert row[0] == [dt.date(2022, m, k) for m, k in ((1, 17), (2, 21), (4, 15), (5, 30), (6, 20), (7, 4), (9, 5), (11, 24), (12, 26))]
    assert row[1:] == ("open", "holiday", "weekend")


def test_backfill_windows(spark):
    windows = one(spark, cal.backfill_windows(d("1999-05-01"), d("2024-04-30"), 10))[0]
    assert [(str(w["low"]), str(w["high"])) for w in windows] == [("2014-05-01", "2024-04-30"), ("2004-05-01", "2014-04-30"), ("1999-05-01", "2004-04-30")]
    assert cal.timeline_dates(dt.date(2024, 5, 7), 1)[-2:] == [dt.date(2024, 3, 31), dt.date(2024, 5, 7)]


def test_labels(spark):
    kinds = [filings.duration_class(F.lit(x)) for x in (91, 125, 181, 0, 401)]
    assert tuple(one(spark, *kinds)) == ("quarter", "other", "ytd", "instant", "other")
    row = one(spark, filings.form_hint(F.lit(" 10-k/A")), filings.period_quarter(F.lit("q3")), filings.frame_parts(F.lit("CY2020Q4I")), filings.frame_parts(F.lit("2020")), filings.padded_cik(F.lit("CIK123")), filings.share_class_ticker(F.lit("BRKB"), F.lit("Some Co Class B")), filings.fiscal_year(F.lit("20")))
    assert row[0] == "annual" and row[1] == 3 and tuple(row[2]) == (2020, 4, True) and row[3] is None and row[4] == "0000000123" and row[5] == "BRK-B" and row[6] is None


def test_texts(spark):
    filing = "x\nItem 5.02 Departure of Directors\nbody &amp; more\nItem 9.01. Exhibits\n(d) Exhibits\n10.1 Some agreement\n10.1  Some agreement.\n99 Press release\nSIGNATURES\n"
    row = one(
        spark, text.items(F.lit(filing), F.lit("8-K")), text.exhibits(F.lit(filing)), text.dividend(F.lit("Dividend raised from $0.50 to $0.55 per share")), text.normalized(F.lit("<p>a&amp;lt;b</p><br/>  c")),
        text.dividend(F.lit("nothing")), text.normalized(F.lit(None).cast("string")), text.infer_tags({"sector": F.lit("Technology"), "industry": F.lit("Tech"), "description": F.lit("cloud"), "market_cap": n(3e9), "last_dividend": n(1.25), "price": n(100)}),
        text.items(F.lit("PART I. Item 1A. Risk factors\nmuch"), F.lit("10-K")),
    )
    assert [(i["code"], i["title"]) for i in row[0]] == [("5.02", "Departure of Directors"), ("9.01", "Exhibits")]
    assert [tuple(e) for e in row[1]] == [("10.1", "Some agreement"), ("99", "Press release")]
    assert row[2]["previous"] == 0.5 and row[2]["current"] == 0.55 and row[3] == "a<b\n c" and row[4] is None and row[5] == ""
    assert row[6] == ["tech", "cloud", "midcap", "high_dividend"] and row[7][0]["code"] == "1A" and not math.isnan(row[2]["current"])


def test_texts_in_other_words(spark):
    said = [
        "The Board raised the dividend from $0.50 to $0.55 per share, or $2.20 on an annualized basis. It was declared on May 2, 2024 and is payable June 14, 2024 to shareholders of record at the close of business on May 20, 2024.",
        "From $1,000.5 to $1,200 per shares; holders of record June 3, 2023 (paid on July 1, 2023).", "rose from $1 to $2 a unit", "", None,
    ]
    rows = one(spark, *[text.dividend(F.lit(t).cast("string")) for t in said])
    assert tuple(rows[0]) == (0.5, 0.55, 2.2, "May 2, 2024", "May 20, 2024", "June 14, 2024")
    assert tuple(rows[1]) == (1000.5, 1200.0, None, None, "June 3, 2023", "July 1, 2023") and [rows[i] for i in (2, 3, 4)] == [None] * 3
    filing = "Part II\nITEM 8. Statements.\nsums\nItem 9B\nnone\nItem 5 of the list is short\nItem one\n"
    row = one(
        spark, text.items(F.lit(filing), F.lit("10-K")), text.items(F.lit("plain"), F.lit("8-K")), text.items(F.lit(None).cast("string"), F.lit("8-K")), text.exhibits(F.lit("( d )  Exhibits\n3.1.a By-laws of it.\n10 ab\nItem 9.01 more\n4 not this")),
        text.exhibits(F.lit("no list")), text.normalized(F.lit("a&#8217;s &#128512;&#0;&#55296; b<br />c</LI>d")), text.infer_tags({}),
    )
    assert [(i["code"], i["title"], i["body"]) for i in row[0]] == [("8", "Statements", "sums"), ("9B", None, "none"), ("5", "of the list is short", "Item one")]
    assert row[1] == [] and row[2] is None and [tuple(e) for e in row[3]] == [("3.1.a", "By-laws of it")] and row[4] == []
    assert row[5] == "a’s 😀 b\nc\nd" and row[6] == ["non_dividend"]


def test_day_distance_and_revenue_families(spark):
    days = spark.sql("select date'2024-03-01' as a, date'2024-02-27' as b union all select null, date'2024-01-01'")
    assert sorted([r[0] for r in days.select(cal.day_distance(F.col("a"), F.col("b"))).collect()], key=str) == [3, None]
    rows = spark.createDataFrame([("Regional Banks", "bank"), ("Regional Banks", "reit"), ("Software", "general"), ("Software", "bank"), (None, None), (" Electric UTILITIES ", "utility"), ("Health Care", "healthcare")], "industry string, family string")
    assert [r[0] for r in rows.select(text.allowed_revenue_family(F.col("industry"), F.col("family"))).collect()] == [True, False, True, False, True, True, True]
