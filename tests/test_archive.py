"""The archive data source on small archives."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive, facts


def company(i, n=3):
    points = [{"start": "2020-01-01", "end": f"2020-0{m}-28", "val": i * 10 + m, "accn": f"a{m}", "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-09-01"} for m in range(1, n + 1)]
    return {"cik": i, "entityName": f"Company {i} é", "facts": {"us-gaap": {"Revenues": {"label": "R", "description": None, "units": {"USD": points}}}}}


@pytest.fixture()
def archived(tmp_path):
    def build(name, documents, method=zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.writestr("README.txt", "no company")
            for i, d in documents:
                z.writestr(f"CIK{i:010d}.json", d if isinstance(d, str) else json.dumps(d))
        return f"file://{tmp_path}/{name}"

    return build


def test_documents_equal_separate_files(spark, archived, tmp_path):
    docs = [(i, company(i, i % 4)) for i in range(1, 30)]
    path = archived("a.zip", docs)
    for i, d in docs:
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / f"{i}.json").write_text(json.dumps(d))
    good, bad = archive.companies_of(archive.read_archive(spark, path, partitionBytes="500"))
    show = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert bad.count() == 0 and show(facts.flatten(good)) == show(facts.flatten(facts.read_companies(spark, f"{tmp_path}/plain")))
    assert archive.read_archive(spark, path, partitionBytes="500").rdd.getNumPartitions() > 5
    listing = archive.read_archive(spark, path, documents=False)
    assert listing.count() == 29 and listing.columns == ["cik", "name", "size", "compressed", "offset", "crc", "method"]
    stored = archived("s.zip", docs[:3], zipfile.ZIP_STORED)
    assert archive.read_archive(spark, stored).where("document is not null").count() == 3
    assert archive.read_archive(spark, archived("none.zip", [])).count() == 0


def test_filters_choose_entries_before_they_are_read(spark, archived):
    path = archived("f.zip", [(i, company(i)) for i in range(1, 20)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        table = archive.read_archive(spark, path, partitionBytes="1")
        for some in (table.where("cik = '0000000007'"), table.where(F.col("cik").isin("0000000007", "0000000008", "x")).where("cik <> '0000000008'")):
            assert some.rdd.getNumPartitions() <= 2 and [r["cik"] for r in some.select("cik").collect()] == ["0000000007"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert table.where("cik = '0000000007'").count() == 1


def test_only_new_and_changed_entries_are_inflated(spark, archived, tmp_path):
    docs = [(i, json.dumps(company(i))) for i in range(1, 9)] + [(20, "{no json"), (21, "[]")]
    path = archived("c.zip", docs)
    raw = bytearray((tmp_path / "c.zip").read_bytes())
    listing = {r["cik"]: r for r in archive.read_archive(spark, path, documents=False).collect()}
    # entries 1 to 4 are unchanged and their bytes destroyed: were one inflated, it would show as an error
    for i in (1, 2, 3, 4, 5):
        at = listing[f"{i:010d}"]["offset"]
        raw[at + 60 : at + 70] = b"\0" * 10
    (tmp_path / "c.zip").write_bytes(bytes(raw))
    state = spark.createDataFrame([(f"{i:010d}", listing[f"{i:010d}"]["size"]) for i in (1, 2, 3, 4)] + [("0000000006", 1)], "cik string, size long")
    changes = archive.scan_changes(spark, path, state)
    assert {r["cik"][-2:]: r["change"] for r in changes.collect()} == {"05": "new", "06": "changed", "07": "new", "08": "new", "20": "new", "21": "new"}
    read = archive.read_changes(changes, path)
    good, bad = archive.companies_of(read)
    assert sorted(int(r["cik"]) for r in good.collect()) == [6, 7, 8]
    errors = {r["cik"][-2:]: r["error"] for r in bad.collect()}
    assert errors.keys() == {"05", "20", "21"} and errors["20"] == "no company document" and errors["05"] != "no company document"
    allowed = spark.createDataFrame([("0000000007",), ("0000000001",)], "cik string")
    assert [r["cik"] for r in archive.scan_changes(spark, path, state, allowed).collect()] == ["0000000007"]
    assert archive.scan_changes(spark, path, state, allowed, force=True).count() == 2
    again = spark.createDataFrame([(k, r["size"]) for k, r in listing.items()], "cik string, size long")
    assert archive.read_changes(archive.scan_changes(spark, path, again), path).count() == 0


def test_other_readers_on_small_files(spark, tmp_path):
    (tmp_path / "sub.json").write_text(json.dumps({"cik": "320193", "filings": {"recent": {"accessionNumber": ["a", "b", "c"], "filingDate": ["2024-02-01", "2023-01-01", "bad"], "form": ["8-K", "8-K", "8-K"], "primaryDocument": ["x.htm", "y.htm", "z.htm"]}}}))
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in facts.read_submissions(spark, f"{tmp_path}/sub.json", ["8-K"], "2023-06-01").collect()] == [("a", "8-K", "x.htm")]
    (tmp_path / "bars.csv").write_text("ticker,price_date,open,high,low,close,volume\nbrk-b,2024-01-02,1,2,0.5,1.5,100\nx,2024-01-03,1,1,1,-1,5\ny,none,1,1,1,1,5\nz,2024-01-04,,,,2,\n")
    assert [(r["close"], r["volume"]) for r in facts.read_bars(spark, f"{tmp_path}/bars.csv").orderBy("price_date").collect()] == [(1.5, 100), (2.0, None)]
    raw = spark.createDataFrame([(" aapl ", "Apple", "", "Hardware", None, " text ", "12.5", "x", "", "3")], "ticker string, company_name string, sector string, industry string, country string, description string, market_cap string, beta string, last_dividend string, price string")
    row = facts.profile_rows(raw).first()
    assert (row["ticker"], row["sector"], row["description"], row["market_cap"], row["beta"], row["last_dividend"], row["price"]) == ("AAPL", None, "text", 12.5, None, None, 3.0)
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    facts.write_keyed(frame, f"{tmp_path}/keyed", "k")
    facts.write_keyed(spark.createDataFrame([("b", 9)], "k string, v int"), f"{tmp_path}/keyed", "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/keyed").collect()) == [("a", 1), ("b", 9)]
    rows = spark.createDataFrame([("1", "A", "USD", "10-K", 1.0, "2020-01-01"), ("2", "A", "USD", "10-Q", 1.0, "2020-01-01"), ("1", "B", "EUR", "10-K", 1.0, None)], "cik string, tag string, unit string, form string, val double, end string")
    assert facts.facts_of(rows).count() == 2 and facts.facts_of(rows, cik="1").count() == 1 and facts.facts_of(rows, tags=["A"], forms=["10-Q"], unit="USD").first()["cik"] == "2"
