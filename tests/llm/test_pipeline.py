"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

import os
import re

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_components, python_spans
    from tidemark.session import materialize

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        kept[name] = docs.collect()
    assert all(any(map(str.isalpha, r["text"] or "")) for r in kept["language_id"])
    groups = brute_components([(r["doc_id"], r["text"]) for r in kept["language_id"]])
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted({c for c in groups.values()})
    assert sorted(r["doc_id"] for r in kept["secret_scans"]) == sorted(r["doc_id"] for r in kept["near_dedup"]) and not any(python_spans(r["text"]) for r in kept["secret_scans"])
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert words(kept["source_mixing"]) == pytest.approx(1.5 * words(kept["secret_scans"]), rel=0.2)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len({(r["doc_id"]) for r in packed}) == len({r["doc_id"] for r in kept["source_mixing"]}) and max(r["offset"] + r["length"] for r in packed) <= 4096


def test_registered_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.llm import queries

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, text in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, SMALL), c.sql(text)
        names = sorted(got.columns)
        assert names == sorted(want.columns), name
        rows = lambda records: sorted(tuple(str(r[n]) for n in names) for r in records)
        assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r)) for r in want.fetchall()), name


def test_stages_with_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import DOCS, docs
    from tidemark.session import materialize

    plain = [(i, f"some plain words of document number {i} that is not like the others {'x' * i}", "ab"[i % 2]) for i in range(40)]
    odd = [(50, None, "a"), (51, "", None), (52, "12 34", "a"), (None, "words under no id", None), (None, None, None), (3, plain[3][1], "b"), (54, "long words " * 60_000, "a"), (55, plain[5][1], None), (56, "password=abcdefgh12 here", "b")]
    table = docs(spark, plain + odd).withColumn("lang_pred", F.lit("own")).withColumn("whole", F.lit(9))
    for rows in (table, table.limit(0)):
        empty = rows is not table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = materialize(stage(spark, rows, SMALL), name)
            assert rows.columns == table.columns, name
            told = rows.collect()
            assert all(r["lang_pred"] == "own" and r["whole"] == 9 and r["found"] == "f" and r["blob"] == "b" for r in told), name
            ids = [r["doc_id"] for r in told]
            if empty:
                assert not told
            elif name == "language_id":
                assert not {50, 51, 52} & set(ids) and ids.count(3) == 2 and None in ids
            elif name == "near_dedup":
                assert ids.count(3) == 1 and 55 not in ids and {None, 54, 5} <= set(ids)
            elif name == "secret_scans":
                assert [r["text"] for r in told if r["doc_id"] == 56] == ["[secret] here"] and [r["n_chars"] for r in told if r["doc_id"] == 56] == [13]
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
        assert (not packed) == empty and all(r["offset"] + r["length"] <= 4096 for r in packed)
    assert DOCS.startswith("doc_id")
