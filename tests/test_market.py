"""Matched partitions, samples by lot, vendor symbols, sessions and registry trees on small cases."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import methodology, sampling, sessions, structure, symbols

D = dt.date


def test_matched_families_equal_brute_force(spark):
    rng = random.Random(9)
    n = 80
    left, right = [rng.choice((0, 0, 3, 7, 11)) for _ in range(n)], [rng.choice((1, 1, 2, 5)) for _ in range(n)]
    size, tokens = [rng.randint(1, 4) for _ in range(n)], [[t for t in "uvwxyz" if rng.random() < 0.5] for _ in range(n)]
    found = spark.createDataFrame(list(zip(range(n), size, tokens)), "idx long, size long, tokens array<string>")
    label = lambda v: spark.createDataFrame(list(enumerate(v)), "idx long, label long")
    order = lambda v: {k: i + 1 for i, k in enumerate(sorted(set(v), key=lambda k: (-v.count(k), k)))}
    lo, ro = order(left), order(right)
    cells = {}
    for i in range(n):
        cells.setdefault((lo[left[i]], ro[right[i]]), []).append(i)
    weight = {c: (len(m), sum(size[i] for i in m)) for c, m in cells.items()}
    best = sorted(cells, key=lambda c: (-weight[c][0], -weight[c][1], *c))[:8]
    got = structure.matched_families(found, label(left), label(right)).orderBy("rank").collect()
    assert [(r["left_family"], r["right_family"], r["overlap"], r["entities"]) for r in got] == [(*c, *weight[c]) for c in best]
    for r, c in zip(got, best):
        nl, nr = sum(w[0] for x, w in weight.items() if x[0] == c[0]), sum(w[0] for x, w in weight.items() if x[1] == c[1])
        assert r["overlap_jaccard"] == pytest.approx(weight[c][0] / (nl + nr - weight[c][0])) and r["share_of_left"] == pytest.approx(weight[c][0] / nl)
        first = lambda side, other: min((x for x in cells if x[side] == c[side]), key=lambda x: (-weight[x][0], -weight[x][1], x[other])) == c
        assert r["mutual_best"] == (first(0, 1) and first(1, 0))
        held = {t: (sum(size[i] for i in cells[c] if t in tokens[i]), sum(t in tokens[i] for i in cells[c])) for t in "uvwxyz"}
        assert r["top_tokens"] == sorted((t for t in held if held[t][1]), key=lambda t: (-held[t][0], -held[t][1], t))[:5]
    grid = spark.createDataFrame([(0.4, 0.6, 0.5), (0.6, 0.6, 0.7), (0.6, 0.8, 0.7)], "jaccard_t double, hamming_t double, adjusted_rand double")
    assert structure.best_cell(grid) == (0.6, 0.6) and structure.best_cell(grid.limit(0)) is None
    assert structure.matched_families(found.limit(0), label(left), label(right)).count() == 0


def test_samples_are_the_same_however_rows_lie(spark):
    rows = [(g, f"item {i}", i) for i in range(600) for g in ("a", "b") if i % 3 or g == "a"] + [("c", "only", 1), ("c", None, 2)]
    lot = lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest()
    want = {(g, i) for g in "abc" for i in sorted({i for k, i, _ in rows if k == g and i}, key=lot)[:20]}
    shown = lambda df: {(r["g"], r["item"]) for r in df.collect()}
    frame = spark.createDataFrame(rows, "g string, item string, v int")
    whole = sampling.bottom_k(frame, ["g"], "item", 20, "s")
    assert shown(whole) == want == shown(sampling.bottom_k(frame.repartition(7, "v"), ["g"], "item", 20, "s")) and whole.count() == len(want)
    parts = [sampling.bottom_k(frame.where(F.col("v") % 3 == k), ["g"], "item", 20, "s") for k in range(3)]
    assert shown(sampling.merged(sampling.merged(parts[0], parts[1], ["g"], 20), parts[2], ["g"], 20)) == want
    assert shown(sampling.bottom_k(frame, ["g"], "item", 12, "s")) < want and shown(sampling.bottom_k(frame, ["g"], "item", 20, "other")) != want
    assert "WindowGroupLimit" in whole._jdf.queryExecution().executedPlan().toString()


def test_symbols_by_rank(spark):
    catalog = spark.createDataFrame(
        [(1, "AAA", "OTC", "stock"), (2, "aaa", "NYSE", "stock"), (3, "AAA", "NYSE", "etf"), (4, "BRK.B", "NYSE", "stock"), (5, "EEE", "LSE", "etf"), (6, "FUND", None, "stock"), (7, "XYA", "OTC", "stock"), (8, "XY.A", "NYSE", "stock"), (9, None, "NYSE", "stock")],
        "listing long, symbol string, exchange string, kind string",
    )
    asked = spark.createDataFrame([(t,) for t in (" aaa ", "AAA", "BRK-B", "brkb", "EEE", "FUND", "XYA", "NONE", "", None, "OLD", "SKIP", "THIN")], "ticker string")
    known = spark.createDataFrame(
        [("OLD", "OLD.X", "NYSE", "verified", "manual"), ("SKIP", None, None, "disabled", "auto_skip_share_class"), ("THIN", "T", None, "verified", "auto"), ("AAA", None, None, "disabled", "manual"), ("UNASKED", "U", "NYSE", "verified", "auto")],
        "ticker string, provider_symbol string, exchange string, status string, source string",
    )
    told = {r["ticker"]: (r["provider_symbol"], r["exchange"], r["status"], r["source"]) for r in symbols.resolve(asked, catalog).collect()}
    fallback = "auto_compact_share_class_fallback"
    assert told == {
        "AAA": ("aaa", "NYSE", "verified", "auto"), "BRK-B": ("BRK.B", "NYSE", "verified", fallback), "BRKB": ("BRK.B", "NYSE", "verified", fallback), "EEE": ("EEE", "LSE", "verified", "auto"), "FUND": ("FUND", None, "verified", "auto"),
        "XYA": ("XYA", "OTC", "verified", "auto"), "NONE": (None, None, "unresolved", "auto"), "OLD": (None, None, "unresolved", "auto"), "SKIP": (None, None, "unresolved", "auto"), "THIN": (None, None, "unresolved", "auto"),
    }
    again = {r["ticker"]: (r["provider_symbol"], r["status"], r["source"]) for r in symbols.resolve(asked, catalog, known).collect()}
    assert again["OLD"] == ("OLD.X", "verified", "manual") and again["AAA"] == (None, "disabled", "manual") and again["SKIP"][1] == again["THIN"][1] == "unresolved" and len(again) == len(told)


def test_sessions(spark):
    calendar = sessions.sessions(spark, "2021-12-20", "2025-01-10").cache()
    rows = {r["session"]: r for r in calendar.collect()}
    assert {d for d, r in rows.items() if r["early_close"] and d.year == 2024} == {D(2024, 7, 3), D(2024, 11, 29), D(2024, 12, 24)}
    assert D(2021, 12, 31) in rows and D(2021, 12, 24) not in rows and D(2022, 1, 3) in rows and D(2022, 6, 20) not in rows and D(2023, 1, 2) not in rows
    assert {d.year: sum(x.year == d.year for x in rows) for d in rows if d.year in (2022, 2023, 2024)} == {2022: 251, 2023: 250, 2024: 252}
    assert sorted(r["ordinal"] for r in rows.values()) == list(range(len(rows)))
    assert str(rows[D(2024, 7, 3)]["closes_at"]) == "2024-07-03 17:00:00" and str(rows[D(2024, 1, 3)]["opens_at"]) == "2024-01-03 14:30:00"
    days = spark.createDataFrame([(D(2024, 7, 4),), (D(2024, 7, 6),), (D(2021, 1, 1),), (D(2025, 1, 9),)], "day date")
    later = {(r["day"], r["sessions"]): r["target"] for r in sessions.sessions_later(days, calendar, "day", (0, 1, 2)).collect()}
    assert later[D(2024, 7, 4), 0] == D(2024, 7, 3) and later[D(2024, 7, 4), 1] == D(2024, 7, 5) and later[D(2024, 7, 6), 1] == D(2024, 7, 8)
    assert (D(2021, 1, 1), 0) not in later and later[D(2025, 1, 9), 1] == D(2025, 1, 10) and (D(2025, 1, 9), 2) not in later
    pair = spark.createDataFrame([(D(2024, 7, 3), D(2024, 7, 8)), (D(2024, 7, 8), D(2024, 7, 3)), (D(2020, 1, 1), D(2024, 7, 3))], "a date, b date")
    assert [r["sessions"] for r in sessions.sessions_between(pair, calendar, "a", "b").orderBy("a").collect()] == [None, 3 - 1, -2]
    bars = spark.createDataFrame([("X", D(2024, 7, 3), 10.0), ("X", D(2024, 7, 5), 11.0), ("X", D(2024, 7, 8), 0.0)], "ticker string, price_date date, close double")
    members = spark.createDataFrame([("X", D(2024, 7, 4)), ("Y", D(2024, 7, 4))], "ticker string, as_of date")
    assert [(r["sessions"], round(r["forward_return"], 9)) for r in sessions.forward_session_returns(members, bars, calendar, (1, 2)).collect()] == [(1, 0.1)]


def test_registry_tree(spark):
    features = spark.createDataFrame([("g", "x", "m2", "k1"), ("g", "x", "m1", "k1"), ("g", "y", "m1", "k2"), ("h", "x", "m1", "k1"), ("g", "x", "m1", "k1")], "factor string, axis string, metric_key string, feature_key string")
    states = spark.createDataFrame([("g", "x", "b", 1), ("g", "x", "a", 1), ("g", "x", "z", 0), ("only", "x", "s", 1)], "factor string, axis string, signal_key string, priority int")
    seen = spark.createDataFrame([("1", "g", "x", "m1", "k1"), ("1", "g", "x", "m1", "k1"), ("2", "g", "x", "m1", "k1")], "cik string, factor string, axis string, metric_key string, feature_key string")
    tree = {r["factor"]: r for r in methodology.registry_tree(features, states, seen, {"g": "G!", "g.z": "Zed", "h.k1": "K"}).collect()}
    g = tree["g"]["axes"]
    assert tree["g"]["label"] == "G!" and [a["axis"] for a in g] == ["x", "y"] and [(s["signal_key"], s["label"]) for s in g[0]["signals"]] == [("z", "Zed"), ("a", "a"), ("b", "b")]
    assert [(m["metric_key"], m["companies"]) for m in g[0]["features"][0]["metrics"]] == [("m1", 2), ("m2", 0)] and g[1]["signals"] == []
    assert tree["h"]["axes"][0]["features"][0]["label"] == "K" and tree["only"]["axes"][0]["features"] == [] and len(tree) == 3


def test_sweep_deletes_what_the_application_wrote(spark, monkeypatch, tmp_path):
    from tidemark import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    kept = spark.range(3).coalesce(1)
    kept.write.parquet(f"{tmp_path}/shared/other")
    session.materialize(kept, "a"), session.materialize(kept, "b")
    here = tmp_path / "shared" / "tidemark" / spark.sparkContext.applicationId
    assert len(list(here.iterdir())) == 2
    session.sweep(spark)
    assert not here.exists() and (tmp_path / "shared" / "other").exists()
