"""Small cases of the series, price, graph, portfolio and validation operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import communities, enrichment, features, periods, portfolio, relational, rules, signals, structure, timeline, valuation
from tidemark.sources import facts

D = dt.date


def series(spark, rows):
    """rows: (end, val, fiscal_year, fiscal_quarter)"""
    return spark.createDataFrame(
        [("1", "revenue", "flow", "USD", v, e - dt.timedelta(days=90), e, e + dt.timedelta(days=30), 91, y, q) for e, v, y, q in rows],
        "cik string, metric_key string, fact_type string, unit string, val double, start date, end date, effective_date date, duration_days int, fiscal_year int, fiscal_quarter int",
    )


ENDS = [D(2022, 3, 31), D(2022, 6, 30), D(2022, 9, 30), D(2022, 12, 31), D(2023, 3, 31)]


def test_ttm_by_date_gap(spark):
    told = enrichment.enrich_flow(series(spark, [(e, float(i + 1), None, None) for i, e in enumerate(ENDS[:4])])).orderBy("end").collect()
    assert told[3]["ttm_val"] == 10 and told[3]["ttm_source_kind"] == "comparable_date_gap" and told[2]["ttm_val"] is None


def test_growth_and_flags(spark):
    rows = [(ENDS[0], -100.0, 2022, 1), (ENDS[1], 5.0, 2022, 2), (ENDS[2], 6.0, 2022, 3), (ENDS[3], 7.0, 2022, 4), (ENDS[4], 90.0, 2023, 1)]
    last = enrichment.enrich_flow(series(spark, rows)).orderBy(F.desc("end")).first()
    assert last["yoy"] == pytest.approx(1.9) and last["is_turnaround"] and not last["is_deterioration"] and last["yoy_source_kind"] == "strict_fiscal_quarter" and last["ttm_source_kind"] == "strict_fiscal_quarters"
    assert last["effective_date"] == ENDS[4] + dt.timedelta(days=30)


def test_enrichment_of_nothing_and_nulls(spark):
    assert enrichment.enrich_flow(series(spark, [])).count() == 0
    told = enrichment.enrich_flow(series(spark, [(ENDS[0], None, 2022, 1), (ENDS[4], 3.0, 2023, 1)])).orderBy("end").collect()
    assert told[1]["yoy"] is None and told[1]["is_turnaround"] is None


def test_as_of_with_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 1)), ("b", D(2024, 1, 5)), ("a", None)], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 1), ("a", D(2024, 1, 5), 2), ("a", D(2024, 1, 5), 3)], "k string, at date, v int")
    told = {(r["k"], r["d"]): r["v"] for r in relational.as_of(left, right, ["k"], "d", "at", tie=["v"]).collect()}
    assert told == {("a", D(2024, 1, 5)): 3, ("a", D(2024, 1, 1)): None, ("b", D(2024, 1, 5)): None, ("a", None): None}


def test_forward_drops_invalid_close(spark):
    dates = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 1, 3))], "k string, d date")
    bars = spark.createDataFrame([("a", D(2024, 1, 2), 0.0), ("a", D(2024, 1, 4), 5.0)], "k string, at date, close double")
    told = relational.first_on_or_after(dates, bars, ["k"], "d", "at", "close").collect()
    assert [(r["d"], r["at"], r["close"]) for r in told] == [(D(2024, 1, 3), D(2024, 1, 4), 5.0)]


def test_replace_and_upsert(spark):
    stored = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    fresh = spark.createDataFrame([("x", 9), (None, 8)], "k string, v int")
    assert sorted((r["k"] or "", r["v"]) for r in relational.replace_slice(stored, fresh, ["k"]).collect()) == [("", 8), ("x", 9), ("y", 2)]
    twice = spark.createDataFrame([("x", 1, 1), ("x", 2, 2)], "k string, v int, o int")
    assert relational.last_wins(twice, ["k"], "o").first()["v"] == 2


def test_window_score_and_reconstruction(spark):
    row = spark.range(1).select(periods.window_score(*[F.lit(x).cast("date") for x in ("2023-01-01", "2024-01-07", "2023-01-01", "2023-12-31")], (14, 21)).alias("s")).first()["s"]
    assert row["score"] == pytest.approx(0.854167, abs=1e-6) and row["match"] == "near"
    cumulative = spark.createDataFrame(
        [("1", "t", "USD", D(2023, 1, 1), D(2023, 3, 31), 100.0, D(2023, 4, 30)), ("1", "t", "USD", D(2023, 1, 1), D(2023, 6, 30), 250.0, D(2023, 7, 30))],
        "cik string, tag string, unit string, start date, end date, val double, filed date",
    )
    (built,) = periods.from_differences(cumulative).collect()
    assert (built["start"], built["end"], built["val"], built["duration_days"], built["source_kind"]) == (D(2023, 4, 1), D(2023, 6, 30), 150.0, 91, "cumulative_derived")


def _map(spark, **values):
    item = lambda k, v: F.struct(F.lit(k), F.struct(F.lit(float(v)).alias("value"), F.lit(2).alias("metrics")))
    return F.map_from_entries(F.array(*[item(k, v) for k, v in values.items()]))


def test_rules(spark):
    at = _map(spark, a=1.0, b=-2.0)
    rule = signals.Signal("f", "x", "s", 1, all=(signals.Condition("a", ">=", 1),), any=(signals.Condition("b", ">", 0), signals.Condition("b", "<", 0)))
    empty = signals.Signal("f", "x", "e", 2)
    row = spark.range(1).select(
        signals.matches(rule, at).alias("m"), signals.matches(empty, at).alias("e"), signals.matches(empty, at, False).alias("v"), signals.holds(signals.Condition("zzz", ">", 0), at).alias("absent"),
        signals.threshold_distance(at, rule).alias("t"), signals.holds(signals.Condition("a", "=", 1, 3), at).alias("few"),
    ).first()
    assert tuple(row) == (True, True, False, False, 0.0, False)


FEATURES = "ticker string, cik string, factor string, axis string, metric_key string, feature_key string, feature_value double, period_end date, effective_date date"


def random_features(spark, n=4, seed=3):
    import random

    rng = random.Random(seed)
    rows = []
    for e in range(n):
        for q in range(24):
            for m in ("revenue", "income", "cash"):
                for k in ("a", "b"):
                    if rng.random() < 0.7:
                        day = D(2015, 1, 1) + dt.timedelta(days=90 * q + rng.choice((0, 0, 5)))
                        value = rng.choice((None, float("inf"), float("nan"), 0.0, 1.0, -1.0, rng.uniform(-2, 2), rng.uniform(-2, 2)))
                        rows.append((f"T{e}" if rng.random() < 0.8 else f"U{e}", f"{e}" if e else None, "f", "x", m, k, value, day, day + dt.timedelta(days=rng.choice((30, 30, 200)))))
    return spark.createDataFrame(rows, FEATURES)


RULES = signals.Registry([
    signals.Signal("f", "x", "up", 1, all=(signals.Condition("a", ">=", 0.5, 2), signals.Condition("b", ">", -1.0)), supporting=("a", "b"), full_metrics=3),
    signals.Signal("f", "x", "odd", 2, any=(signals.Condition("zzz", ">", 0), signals.Condition("b", "<", -0.7), signals.Condition("a", "<", -0.7)), supporting=("b",), contradicting=("a",)),
    signals.Signal("f", "x", "none", 5, default=True, supporting=("a",)), signals.Signal("f", "y", "elsewhere", 1),
])


def test_timeline_equals_a_build_for_each_date_and_reads_features_once(spark):
    features_ = random_features(spark)
    dates = [str(D(2014, 1, 31) + dt.timedelta(days=25 * i)) for i in range(120)]
    told = signals.timeline(features_, RULES, dates)
    show = lambda df: sorted(str(tuple(r)) for r in df.select("entity", "signal_key", "primary_feature_key", "signal_value", "confidence", "supporting", "contradicting", "total_metrics", "period_end", "effective_date").collect())
    every = told.cache()
    for d in dates[::13] + dates[-1:]:
        assert show(every.where(F.col("as_of") == d)) == show(signals.build(features_, RULES, d)), d
    # the choices are those of the rules taken one by one
    latest = {(r["entity"], r["factor"]): r for r in signals.build(features_, RULES).collect()}
    for r in signals.scopes(signals.aggregates(features_)).collect():
        own = {k: (v["value"], v["metrics"]) for k, v in r["features"].items()}
        ok = lambda k, t: k in own and t(*own[k])
        up = ok("a", lambda v, n: v >= 0.5 and n >= 2) and ok("b", lambda v, n: v > -1)
        odd = ok("b", lambda v, n: v < -0.7) or ok("a", lambda v, n: v < -0.7)
        assert latest[r["entity"], "f"]["signal_key"] == ("up" if up else "odd" if odd else "none")
    changes = signals.timeline(features_, RULES, dates, changed_only=True)
    by = {}
    for r in every.orderBy("as_of").collect():
        if not by.get(r["entity"]) or by[r["entity"]][-1][1] != r["signal_key"]:
            by.setdefault(r["entity"], []).append((r["as_of"], r["signal_key"]))
    assert by == {e: [(r["as_of"], r["signal_key"]) for r in changes.orderBy("as_of").collect() if r["entity"] == e] for e in by}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(signals.timeline(features_, RULES, dates)) < size(signals.timeline(features_, RULES, dates[:2])) + 200 * len(dates)
    assert every.where("false").count() == 0 and signals.build(features_.limit(0), RULES).count() == 0


def test_stored_rules_with_faults(spark):
    good = rules.store(spark, RULES.signals)
    bad = [("factor_signal", "v0", "f", "x", k, "L", 1, s, e, "{}", True) for k, s, e in (("no json", "{oops", "{}"), ("wrong type", '{"all": "a"}', "{}"), ("null", None, "{}"), ("list", "[1]", "{}"))]
    bad += [("factor_signal", "v0", "f", "x", "off", "L", 0, "{}", "{}", "{}", False), ("factor_signal", "v1", "f", "x", "later", "L", 0, "{}", "{}", "{}", True)]
    bad += [("factor_signal", "v0", "f", "x", "up", "repeated", 99, "{}", "{}", "{}", True), ("factor_signal", "v0", "f", "x", "unknown", "L", 0, '{"all":[{"featureKey":"a","operator":"~","value":1}], "more": 1}', '{"contextFeatureKeys":["b"]}', "{}", True)]
    read = rules.read(good.unionByName(spark.createDataFrame(bad, rules.STORED)))
    assert {r["signal_key"] for r in read.rejected.collect()} == {"no json", "wrong type", "null", "list"} and all(r["faults"] == ["selection_rules"] for r in read.rejected.collect())
    assert {r["signal_key"] for r in read.definitions.collect()} == {"up", "odd", "none", "elsewhere", "unknown"}
    one = read.definitions.where("signal_key = 'unknown'").first()
    assert (one["supporting"], one["max_items"], one["least_metrics"], one["full_metrics"]) == (["b"], 5, 1, 1)
    features_ = random_features(spark)
    show = lambda df: sorted(str(tuple(r)) for r in df.drop("feature_values", "feature_metrics").collect())
    assert show(signals.build(features_, read)) == show(signals.build(features_, RULES))


def test_similarity_case(spark):
    found = spark.createDataFrame([(0, ["a", "b"], ["a", "b"], 1), (1, ["a", "c"], ["a", "c"], 1)], "idx long, state_vector array<string>, tokens array<string>, size long")
    row = structure.pair_similarity(found).first()
    assert row["jaccard"] == pytest.approx(1 / 3) and row["idf_jaccard"] == pytest.approx(0.239812, abs=1e-6) and row["hamming"] == 0.5


def test_components_of_a_chain_and_keys(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(30)] + [(2, 5, 9)], "k int, a long, b long")
    told = structure.components(edges, ("k",)).collect()
    assert {r["label"] for r in told if r["k"] == 1} == {0} and sorted((r["node"], r["label"]) for r in told if r["k"] == 2) == [(5, 5), (9, 5)]
    assert structure.components(edges.where("a < 0").drop("k")).count() == 0


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, 1, 2), (1, 1, 3)], "x int, y int, z int")
    assert structure.adjusted_rand(df, "x", "y").first()[0] == 1 and structure.adjusted_rand(df.withColumn("w", F.col("z")), "z", "w").first()[0] in (0, 1)
    assert structure.adjusted_rand(df.where("x = 0"), "y", "z").first()[0] == 0


def test_communities_of_two_cliques(spark):
    clique = lambda at: [(at + i, at + j, 1.0) for i in range(4) for j in range(i + 1, 4)]
    edges = spark.createDataFrame([*clique(0), *clique(10), (3, 10, 0.1)], "a long, b long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (*range(4), *range(10, 14), 99)], "idx long")
    for method in (communities.louvain, communities.markov, communities.label_flow):
        told = {r["idx"]: r["label"] for r in method(nodes, edges).collect()}
        assert len({told[i] for i in range(4)}) == 1 and told[10] == told[13] and told[0] != told[10] and told[99] == 99, method.__name__
    labels = communities.louvain(nodes, edges)
    assert communities.modularity(labels, edges).first()["modularity"] > 0.45


def test_turnover_and_bands(spark):
    core = spark.createDataFrame([(1, list("abcde")), (2, list("abcxy")), (3, list("abcxy"))], "as_of int, core array<string>")
    told = timeline.event_bands(timeline.core_changes(core)).orderBy("as_of").collect()
    assert told[1]["turnover"] == pytest.approx(4 / 7) and told[1]["band"] in ("watch", "regime") and told[2]["band"] is None and told[0]["turnover"] is None


def test_portfolio(spark):
    rows = [("p", "A", 10.0, None, 100.0, 10.0, 50.0), ("p", "B", None, 5.0, 50.0, 5.0, 40.0), ("p", "CASH", None, None, 100.0, None, 10.0)]
    items = spark.createDataFrame(rows, "portfolio string, ticker string, shares double, average_price double, total_cost double, current_price double, target_weight double")
    told = {r["ticker"]: r for r in portfolio.rebalance(portfolio.valued(portfolio.complete(items))).collect()}
    assert told["A"]["average_price"] == 10 and told["B"]["shares"] == 10 and told["CASH"]["buy_amount"] == pytest.approx(-75)
    assert told["A"]["buy_amount"] == pytest.approx(75 * 25 / 75) and told["B"]["buy_amount"] == pytest.approx(50) and told["B"]["buy_shares"] == pytest.approx(10)


def test_expectations_case(spark):
    names = {f"{n}{s}" for n, *_ in valuation.INPUTS for s in ("", "_end", "_known")} | {"eps_diluted_growth", "eps_basic_growth"}
    kind = lambda c: "date" if c.endswith(("_end", "_known")) else "double"
    inputs = spark.range(1).select(F.lit("1").alias("cik"), F.lit("2024-01-01").cast("date").alias("as_of"), *[F.lit({"shares": 100.0, "revenue": 100.0}.get(c)).cast(kind(c)).alias(c) for c in sorted(names)])
    prices = spark.createDataFrame([("1", "T", D(2024, 1, 1), D(2024, 1, 1), 8.0)], "cik string, ticker string, as_of date, price_date date, close double")
    row = valuation.expectations(inputs, prices).where("assumption_set = 'base_5y'").first()
    assert row["implied_revenue"] == pytest.approx(161.051) and row["revenue_cagr"] == pytest.approx(0.1) and row["burden_score"] == pytest.approx(0.365079, abs=1e-6)
    assert {r["metric_key"] for r in valuation.composites(inputs, prices).collect()} == {"market_capitalization", "log_market_capitalization", "price_to_sales", "enterprise_value_to_sales"}


def test_registry_round_trip(spark):
    from tidemark.plans.registry import default_features

    assert sorted(map(str, features.read_registry(features.registry_frame(spark, default_features())))) == sorted(map(str, default_features()))


def test_facts_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"cik": 7, "entityName": "X", "facts": {"us-gaap": {"Revenues": {"label": "R", "units": {"USD": [{"start": "2023-01-01", "end": "2023-03-31", "val": 5, "accn": "a", "fy": 2023, "fp": "Q1", "form": "10-Q", "filed": "2023-05-01"}, {"end": "bad", "val": null}]}}}}}')
    rows = facts.flatten(facts.read_companies(spark, str(tmp_path))).orderBy(F.desc_nulls_last("val")).collect()
    assert rows[0]["cik"] == "0000000007" and rows[0]["end"] == D(2023, 3, 31) and rows[1]["end"] is None and rows[1]["val"] is None
    meta = spark.createDataFrame([("Revenues", "revenue", "flow", None)], "tag string, metric_key string, fact_type string, priority int")
    mapped = facts.map_tags(facts.flatten(facts.read_companies(spark, str(tmp_path))), meta).collect()
    assert len(mapped) == 1 and mapped[0]["priority"] == 99 and mapped[0]["duration_days"] == 90
    fresh = facts.flatten(facts.read_companies(spark, str(tmp_path)))
    assert facts.upsert_facts(fresh, fresh).count() == 2


def test_csv_readers(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Fund X\n"as of","today"\nTicker,Name,Weight\nAAA,"A, Inc",5.5%\n-,cash,1\n')
    (tmp_path / "m.csv").write_text("series_id,observation_date,value\nGDP,2024-01-01,.\nGDP,2024-04-01,3.5\n")
    assert [tuple(r) for r in facts.read_holdings(spark, str(tmp_path / "h.csv")).collect()] == [("AAA", "A, Inc", 5.5)]
    assert [r["value"] for r in facts.read_observations(spark, str(tmp_path / "m.csv")).orderBy("observation_date").collect()] == [None, 3.5]


def test_pairs_without_common_tokens_agree_by_state(spark):
    states = [["a=missing", "b=missing", "c=up"], ["a=missing", "b=missing", "c=down"], ["a=x", "b=y", "c=z"], ["a=x", "b=mixed_q", "c=w"], ["a=v", "b=mixed_q", "c=u"]]
    rows = [(i, s, [t.replace("=", ".") for t in s if not t.endswith("missing") and "mixed_" not in t], 1) for i, s in enumerate(states)]
    found = spark.createDataFrame(rows, "idx long, state_vector array<string>, tokens array<string>, size long")
    pairs = structure.pair_similarity(found)
    told = {(r["a"], r["b"]): (r["shared"], r["different"], r["hamming"], r["jaccard"]) for r in pairs.collect()}
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            same, shared = sum(p == q for p, q in zip(x[1], y[1])), len(set(x[2]) & set(y[2]))
            if same:
                want[x[0], y[0]] = (shared, 3 - same, pytest.approx(same / 3), pytest.approx(shared / len(set(x[2]) | set(y[2]))))
    assert told == want and len(want) == 3
    bars = {r["bucket"]: r["n"] for r in structure.histogram(found, pairs).collect()}
    assert sum(bars.values()) == 10 and bars[0] == 7


def test_differences_of_facts_that_several_filings_state(spark):
    day = dt.date
    rows = [(1, "T", "U", day(2023, 1, 1), day(2023, 3, 31), 100.0, day(2023, 4, 1)), (1, "T", "U", day(2023, 1, 1), day(2023, 3, 31), 110.0, day(2024, 4, 1)), (1, "T", "U", day(2023, 1, 1), day(2023, 6, 30), 250.0, day(2023, 7, 1)),
            (1, "T", "U", day(2023, 1, 1), day(2023, 6, 30), 260.0, day(2024, 7, 1)), (1, "T", "U", day(2023, 4, 1), day(2023, 6, 30), 150.0, day(2023, 7, 1))]
    facts = spark.createDataFrame(rows, "cik int, tag string, unit string, start date, end date, val double, filed date")
    told = periods.from_differences(facts).collect()
    assert [(r["start"], r["end"], r["val"], r["duration_days"]) for r in told] == [(day(2023, 4, 1), day(2023, 6, 30), 150.0, 91)]
    lead = periods.from_trailing(facts).collect()
    assert [(r["start"], r["end"], r["val"]) for r in lead] == [(day(2023, 1, 1), day(2023, 3, 31), 110.0)]


def test_spans_stated_twice_keep_both_facts(spark):
    day = dt.date
    facts = spark.createDataFrame([(1, day(2023, 1, 2), day(2023, 4, 1), 5.0)] * 2 + [(1, day(2023, 2, 1), day(2023, 4, 30), 7.0)], "cik int, start date, end date, val double")
    windows = spark.createDataFrame([(1, 2023, 1, day(2023, 1, 1), day(2023, 3, 31))], "cik int, fiscal_year int, fiscal_quarter int, low date, high date")
    told = periods.resolve_quarters(facts, windows).collect()
    assert [(r["val"], r["fiscal_quarter"], r["match"]) for r in told] == [(5.0, 1, "near")] * 2
