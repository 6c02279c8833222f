"""Periods, validators, texts, portfolios, timelines and the relational idioms: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import checks, features, periods, portfolio, relational, structure, timeline
from tidemark.plans import sql
from tidemark.plans.common import rounded
from tidemark.session import if_small
from tidemark.sources import adapters, facts


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from the year's start to each quarter's end."""
    q = adapters.quarters(spark, sf_dir)
    w = Window.partitionBy("s", F.year("start")).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return q.select(F.col("s").alias("cik"), F.lit("Revenues").alias("tag"), F.lit("USD").alias("unit"), F.trunc("start", "year").alias("start"), "end", F.round(F.sum("r").over(w), 4).alias("val"), F.date_add("end", 30).alias("filed"))


def reconstructed_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second to fourth quarters from cumulative facts."""
    return rounded(periods.from_differences(_cumulative(spark, sf_dir)), 4)


def leading_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First quarters from half-years and their second quarters."""
    rows = _cumulative(spark, sf_dir)
    second = adapters.quarters(spark, sf_dir).where("quarter(start) = 2").select(F.col("s").alias("cik"), F.lit("Revenues").alias("tag"), F.lit("USD").alias("unit"), "start", "end", F.col("r").alias("val"), F.date_add("end", 30).alias("filed"))
    return rounded(periods.from_trailing(rows.where("month(end) = 6").unionByName(second)), 4)


def resolved_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts, some a few days off, matched to fiscal windows extrapolated from one annual period."""
    q = adapters.quarters(spark, sf_dir)
    off = (F.col("s") % 5).cast("int")
    rows = q.select(F.col("s").alias("cik"), F.date_add("start", off).alias("start"), F.date_add("end", off).alias("end"), F.col("r").alias("val"))
    annual = q.select(F.col("s").alias("cik")).distinct().select("cik", F.lit(1999).alias("fiscal_year"), F.lit("1999-01-01").cast("date").alias("start"), F.lit("1999-12-31").cast("date").alias("end"))
    windows = periods.quarter_windows(periods.year_windows(annual, (1995, 2001)))
    return rounded(periods.resolve_quarters(rows, windows))


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters, spans from the year's start and snapshots as facts: some days off, with labels that are right, wrong or missing."""
    q = adapters.quarters(spark, sf_dir)
    day = (F.col("s") % 5).cast("int")
    spans = F.array(
        F.struct(F.lit("q").alias("tag"), F.date_add("start", day).alias("start"), F.date_add("end", day).alias("end")),
        F.struct(F.lit("y").alias("tag"), F.trunc("start", "year").alias("start"), F.date_add("end", day).alias("end")),
        F.struct(F.lit("i").alias("tag"), F.lit(None).cast("date").alias("start"), F.date_add("end", day * 5).alias("end")),
    )
    n, label = F.col("s") + F.col("qn"), F.concat(F.lit("Q"), F.col("qn") % 4 + 1)
    return q.withColumn("p", F.explode(spans)).select(
        F.col("s").alias("cik"), "p.*", F.when(n % 3 > 0, F.floor(F.col("qn") / 4) + F.when(n % 7 == 0, 1).otherwise(0)).cast("int").alias("fy"),
        F.when(n % 4 == 1, label).when(n % 4 == 2, F.when(F.col("qn") % 4 == 3, "FY").otherwise("Q1")).alias("fp"), F.when(F.col("qn") % 4 == 3, "10-K").otherwise("10-Q").alias("form"),
        F.when((n % 5 == 0) & (F.col("p.tag") == "q"), F.concat(F.lit("CY"), F.year("end").cast("string"), label)).alias("frame"),
    )


def resolved_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal period of annual, quarterly, cumulative and snapshot facts, by windows and labels."""
    facts_ = _stated(spark, sf_dir)
    annual = facts_.select("cik").distinct().select("cik", F.lit(1996).alias("fiscal_year"), F.lit("1996-01-01").cast("date").alias("start"), F.lit("1996-12-31").cast("date").alias("end"))
    years = periods.year_windows(annual, (1991, 2000))
    return rounded(periods.resolve_periods(facts_, years, periods.quarter_windows(years)))


#: The tag of each line of an order.
_TAGS_BY_LINE = ("AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB", "REG")


def _raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw facts: the line's number tells the tag, a supplier's quarter the filing; every ninth has no start."""
    items = adapters.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"])
    tag = F.element_at(F.array(*map(F.lit, _TAGS_BY_LINE)), F.col("l_linenumber").cast("int"))
    day = F.col("l_shipdate").cast("date")
    return items.select(
        F.col("l_suppkey").cast("string").alias("cik"), F.lit("us").alias("taxonomy"), tag.alias("tag"), F.col("l_returnflag").alias("unit"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("accn"), F.when(F.col("l_orderkey") % 9 != 0, F.date_add(day, -90)).alias("start"), day.alias("end"),
        F.col("l_extendedprice").cast("double").alias("val"), F.date_add(day, 30).alias("filed"), tag.alias("label"), F.lit(None).cast("string").alias("description"),
    )


_KNOWN_TAGS = [("AIR", "revenue", "flow", 1), ("RAIL", "revenue", "flow", None), ("SHIP", "assets", "instant", 3)]


def _tag_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_KNOWN_TAGS, "tag string, metric_key string, fact_type string, priority int")


def mapped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of known tags with their metric, priority and length."""
    told = facts.map_tags(_raw_facts(spark, sf_dir), _tag_meta(spark))
    return told.select("accn", "cik", "tag", "metric_key", "fact_type", "priority", "duration_days", "val")


#: A wider registry: who a tag is open to.
_GATED_TAGS = [("AIR", "revenue", "flow", 1, True, [], ["ASIA"]), ("TRUCK", "revenue", "flow", 5, True, ["EUROPE", "AFRICA"], []), ("MAIL", "capex_cash", "flow", None, True, None, None), ("FOB", "assets", "instant", 2, False, [], []), ("REG", "assets", "instant", 4, True, ["AMERICA"], ["AMERICA"])]


def gated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the wider registry's tags that are open to their company's sector; every ninth company's is unknown, some have spaces around it."""
    meta = spark.createDataFrame(_GATED_TAGS, "tag string, metric_key string, fact_type string, priority int, enabled boolean, include_sectors array<string>, exclude_sectors array<string>")
    k = F.col("cik").cast("long")
    sector = F.when(k % 9 == 0, None).when(k % 9 == 1, F.lit(" ")).when(k % 2 == 0, F.concat(F.lit("  "), "sector", F.lit(" "))).otherwise(F.col("sector"))
    companies = adapters.companies(spark, sf_dir).select(k.cast("string").alias("cik"), sector.alias("sector"))
    told = facts.gate_by_sector(facts.map_tags(_raw_facts(spark, sf_dir), meta), companies)
    return told.select("accn", "cik", "tag", "metric_key", "fact_type", "priority", "duration_days", "val")


def unmapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company, unit and kind the tags that no metric claims, with their newest accession."""
    told = facts.unmapped_tag_stats(_raw_facts(spark, sf_dir), _tag_meta(spark), "1994-01-01")
    return told.select("cik", "tag", "unit", "kind", "n", "first_end", "last_end", "last_filed", "accn", "label")


def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts stored, and those of unit R once more with another value and filed later: the fresh ones win."""
    stored_ = _raw_facts(spark, sf_dir)
    fresh = stored_.where("unit = 'R'").withColumns({"val": F.col("val") + 1, "filed": F.date_add("filed", 400)})
    return facts.upsert_facts(stored_, fresh).select("accn", "cik", "tag", "unit", "start", "end", "val", "filed")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the facts that compete for a company's quarter: fit, priority, filing date, source, confidence, accession."""
    rows = facts.map_tags(_raw_facts(spark, sf_dir), _tag_meta(spark)).select(
        "cik", "metric_key", F.trunc("end", "quarter").alias("period"), (F.round(F.col("val") % 10) / 10).alias("score"), "priority", "filed",
        F.when(F.col("unit") == "A", "direct").when(F.col("unit") == "N", "cumulative_derived").otherwise("segment_merged").alias("source_kind"), F.lit(None).cast("double").alias("confidence"), "accn", "val",
    )
    return periods.best_rows(rows, ["cik", "metric_key", "period"])


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of an archive against a state that knows three quarters of them, some with another size."""
    o = adapters.table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    listing = o.select(F.col("o_orderkey").alias("cik"), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.floor("o_totalprice").alias("size"))
    state = listing.where("cik % 4 <> 0").withColumn("size", F.when(F.col("cik") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return facts.changed_files(listing, state)


def annual_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that differ by more than a tenth from the sum of their quarters; every third company's years are a fifth too high."""
    rows = adapters.flow_series(spark, sf_dir).where("fiscal_year is not null")
    annual = rows.groupBy("cik", "metric_key", "fiscal_year").agg((F.sum("val") * F.when(F.col("cik").cast("int") % 3 == 0, 1.2).otherwise(1.05)).alias("val"), F.max("end").alias("end"))
    told = checks.flow_consistency(annual, rows.select("cik", "metric_key", "fiscal_year", "val"))
    return told.groupBy("metric_key", "check", "severity").agg(F.count("*").alias("n"))


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of one quarter's filing that follow each other without a gap, summed where they make a quarter."""
    items = adapters.table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
    months = items.groupBy(F.col("l_suppkey").alias("cik"), month.alias("start")).agg(F.sum("l_quantity").alias("val"))
    filed = months.withColumn("end", F.last_day("start")).withColumn("accn", F.year("start") * 10 + F.quarter("start"))
    return periods.merge_segments(filed, ["cik", "accn"])


def annual_from_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.flow_series(spark, sf_dir).where("metric_key in ('revenue', 'capex_cash')")
    return rounded(periods.annual_from_quarters(rows), 4)


def fiscal_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years whose end moves by a month in 1998 for every third company."""
    q = adapters.quarters(spark, sf_dir).select("s", F.year("end").alias("y")).distinct()
    moved = (F.col("s") % 3 == 0) & (F.col("y") >= 1998)
    annual = q.select(F.col("s").alias("cik"), F.col("y").alias("fiscal_year"), F.when(moved, F.make_date("y", F.lit(11), F.lit(30))).otherwise(F.make_date("y", F.lit(12), F.lit(31))).alias("end"))
    return periods.regimes(annual)


def formula_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.flow_series(spark, sf_dir).select("cik", "unit", "metric_key", "end", "val", "filed")
    return periods.sum_metric(rows, ("capex_cash", "dividend_payments"), "capex_incurred")


def series_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All validators over the flow series, counted."""
    rows = adapters.flow_series(spark, sf_dir)
    profiles = features.sign_profiles(rows)
    parts = [checks.chronology(rows), checks.quality(rows), checks.integrity(rows), checks.coverage(rows), checks.negatives(rows, profiles)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return checks.report(every)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the normalised texts of all pages."""
    pages = adapters.table(spark, sf_dir, "pages", ["page_id", "html"])
    told = text.normalized(F.col("html"))
    return pages.select("page_id", F.length(told).alias("chars"), F.md5(F.encode(told, "UTF-8")).alias("digest"))


#: Made-up filings by form: {k} is a number.
_FILINGS = {
    "8-K": "HEAD\nItem 5.02 Departure of Officer {k}.\nFirst body\nITEM 9.01. Exhibits\n(d) Exhibits\n99.1. Release {k}.\n101.INS Instance\n(e) Other\n5 not one",
    "10-K": "PART I\nPART I. Item 1A. Risk Factors\nrisk {k}\nItem 7 Discussion\nof items\nand more",
    "10-Q": "Item 2.02 Results\nquarter {k}\nExhibit No.  Description\n10.1 Contract {k}\n10.1 Contract {k}\nno 7",
}
_SAYINGS = [
    "No payment was announced.",
    "The Board raised the quarterly dividend from $0.{k} to $1.{k} per share, payable March {d}, 2024.",
    "It paid $2.{k} on an annualized basis. The dividend was declared on May {d}, 2024, to holders of record at the close of business on June {d}, 2024.",
    "A dividend of $0.{k} (paid July {d}, 2024) was declared.",
]


def _said(texts: list[str], turn) -> F.Column:
    """The text whose turn it is, with the key's numbers written in."""
    number, day = (F.col("o_orderkey") % 90 + 10).cast("string"), (F.col("o_orderkey") % 28 + 1).cast("string")
    filled = [F.replace(F.replace(F.lit(x), F.lit("{k}"), number), F.lit("{d}"), day) for x in texts]
    return F.element_at(F.array(*filled), (turn % len(texts) + 1).cast("int"))


def filing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item headings, titles and bodies of filings of three forms made from orders."""
    form = F.element_at(F.array(*map(F.lit, _FILINGS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    orders = adapters.table(spark, sf_dir, "orders", ["o_orderkey"]).withColumn("form", form)
    rows = orders.select("o_orderkey", F.posexplode(text.items(_said(list(_FILINGS.values()), F.col("o_orderkey")), F.col("form"))).alias("pos", "i"))
    return rows.select("o_orderkey", "pos", "i.*")


def filing_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibit numbers and descriptions of the same filings."""
    orders = adapters.table(spark, sf_dir, "orders", ["o_orderkey"])
    rows = orders.select("o_orderkey", F.posexplode(text.exhibits(_said(list(_FILINGS.values()), F.col("o_orderkey")))).alias("pos", "e"))
    return rows.select("o_orderkey", "pos", "e.*")


def dividend_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = text.dividend(_said(_SAYINGS, F.col("o_orderkey")))
    orders = adapters.table(spark, sf_dir, "orders", ["o_orderkey"]).withColumn("t", told)
    return orders.select("o_orderkey", "t.*", F.col("t").isNull().alias("is_silent"))


def inferred_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.companies(spark, sf_dir).withColumn("k", F.col("cik").cast("int"))
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("k") % len(values) + 1)
    tags = text.infer_tags({
        "sector": pick("Technology", "Energy", "Unknown", None), "industry": pick("Software - Application", "Oil & Gas Midstream", "Regional Banks"), "country": pick("US", "CN", "", "FR", "US"),
        "description": pick("Cloud and data center services", "Runs the grid", "Uses artificial intelligence in retail", None, ""), "is_etf": F.col("k") % 7 == 0,
        "market_cap": F.pow(F.lit(10.0), F.col("k") % 5 + 8), "beta": F.lit(0.5) + F.col("k") % 10 / 10, "last_dividend": (F.col("k") % 6) / 4, "price": F.lit(100.0),
    })
    return c.select("cik", F.concat_ws(",", tags).alias("tags"))


def _portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    price = (F.col("s_suppkey") % 7 + 1).cast("double")
    held = s.select(
        F.col("s_nationkey").alias("portfolio"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.abs("s_acctbal").alias("shares"),
        F.lit(None).cast("double").alias("average_price"), (F.abs("s_acctbal") * 3).alias("total_cost"), price.alias("current_price"), (F.col("s_suppkey") % 4 * 10).cast("double").alias("target_weight"),
    )
    none = F.lit(None).cast("double")
    cash = s.select(F.col("s_nationkey").alias("portfolio")).distinct().select(
        "portfolio", F.lit("CASH").alias("ticker"), none.alias("shares"), none.alias("average_price"), (F.col("portfolio") * 1000 + 500).cast("double").alias("total_cost"), none.alias("current_price"), F.lit(5.0).alias("target_weight")
    )
    return held.unionByName(cash)


def portfolio_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings completed, valued and rebalanced by buying only, for 25 portfolios."""
    told = portfolio.rebalance(portfolio.valued(portfolio.complete(_portfolio(spark, sf_dir))))
    return rounded(told)


def portfolio_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current weights by sector, industry and (several) tags."""
    c = adapters.companies(spark, sf_dir).select("ticker", "sector", "industry", F.array(F.lower("sector"), F.when(F.col("cik").cast("int") % 2 == 0, "even")).alias("tags"))
    held = portfolio.valued(portfolio.complete(_portfolio(spark, sf_dir))).join(if_small(c), "ticker", "left")
    return rounded(portfolio.exposure(held, ["sector", "industry", "tags"]))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.table(spark, sf_dir, "lineitem", ["l_partkey", "l_shipdate", "l_quantity"])
    part = adapters.table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    end = F.date_add(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 3), -1)
    sold = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(end.alias("as_of"), F.col("p_brand").alias("name")).agg(F.sum("l_quantity").alias("sold"))
    return sold.withColumn("rank", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("sold"), "name")))


def core_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best-selling brands of each quarter, their turnover, and event bands."""
    told = timeline.event_bands(timeline.core_changes(timeline.cores(_ranked(spark, sf_dir))))
    return rounded(told.select("as_of", F.concat_ws(",", "core").alias("core"), "turnover", "band"))


def share_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted turnover of the ten best brands' shares between quarters."""
    top = _ranked(spark, sf_dir).where("rank <= 10")
    shares = top.withColumn("share", F.col("sold") / F.sum("sold").over(Window.partitionBy("as_of"))).select("as_of", "name", "share")
    later = shares.withColumn("as_of", F.last_day(F.add_months("as_of", 3)))
    both = timeline.weighted_turnover(later, shares, ["as_of"])
    return rounded(both)


def core_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median return of each quarter's core over 1, 3, 6 and 12 months."""
    members = _ranked(spark, sf_dir).where("rank <= 5").select("as_of", F.col("name").alias("ticker"))
    return rounded(timeline.return_summary(timeline.forward_returns(members, adapters.bars(spark, sf_dir))))


def event_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns after event quarters against the others, and their excess over the benchmark."""
    ranked, bars = _ranked(spark, sf_dir), adapters.bars(spark, sf_dir)
    events = timeline.event_bands(timeline.core_changes(timeline.cores(ranked)))
    members = ranked.where("rank <= 5").select("as_of", F.col("name").alias("ticker"))
    summary = timeline.return_summary(timeline.forward_returns(members, bars))
    spy = timeline.forward_returns(members.select("as_of", F.lit("SPY").alias("ticker")), adapters.benchmark_bars(spark, sf_dir))
    return rounded(timeline.cohorts(summary, events, spy))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional maxima, distinct counts and sorted distinct lists per customer."""
    o = adapters.table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderkey"])
    status = F.col("o_orderstatus")
    return o.groupBy("o_custkey").agg(
        *[F.max(F.when(status == s, F.col("o_totalprice"))).alias(f"max_{s.lower()}") for s in "FOP"], F.countDistinct("o_orderpriority").alias("priorities"),
        F.countDistinct(F.when(status == "F", F.col("o_orderpriority"))).alias("finished_priorities"), F.concat_ws(",", F.sort_array(F.collect_set("o_orderstatus"))).alias("statuses"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest_order"),
    )


def modal_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest order priority of each customer; ties to the one seen first."""
    o = adapters.table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority", "o_orderkey"])
    counted = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return relational.winner_by(counted.withColumn("__f", -F.col("first")), ["o_custkey"], ["n", "__f"]).select("o_custkey", "o_orderpriority", "n")


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles, median, deviation and scaled MAD per status."""
    o = adapters.table(spark, sf_dir, "orders", ["o_orderstatus", "o_totalprice"])
    mid = o.groupBy("o_orderstatus").agg(F.median("o_totalprice").alias("m"))
    away = o.join(F.broadcast(mid), "o_orderstatus").withColumn("d", F.abs(F.col("o_totalprice") - F.col("m")))
    told = away.groupBy("o_orderstatus").agg(
        F.percentile("o_totalprice", 0.8).alias("p80"), F.expr("percentile_disc(0.8) within group (order by o_totalprice)").alias("p80_rank"), F.median("o_totalprice").alias("median"),
        F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("sd_sample"), F.stddev_pop("o_totalprice").alias("sd_population"), (F.median("d") * 1.4826).alias("mad_scale"),
    )
    return rounded(told, 4)


def segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return rounded(structure.share_by(c, "c_mktsegment", 3))


def unordered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi, anti and null-safe joins: customers by whether they ordered, with their nation's region."""
    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    o = adapters.table(spark, sf_dir, "orders", ["o_custkey"])
    same = F.col("c_custkey") == F.col("o_custkey")
    told = c.join(o, same, "left_semi").withColumn("ordered", F.lit(True)).unionByName(c.join(o, same, "left_anti").withColumn("ordered", F.lit(False)))
    n = adapters.table(spark, sf_dir, "nation")
    return told.join(if_small(n), F.col("c_nationkey").eqNullSafe(F.col("n_nationkey")), "left").select("c_custkey", "n_name", "ordered")


def membership_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe replaced by new holdings: members that left stay, inactive."""
    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker")
    stored = c.where("c_acctbal < 6000").select(F.col("c_mktsegment").alias("universe_key"), name, F.lit(True).alias("is_active"))
    held = c.where("c_mktsegment = 'BUILDING' and c_acctbal > 2000").select(name)
    return facts.sync_memberships(stored, held, "BUILDING")


def changed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order that is newer than their last finished one."""
    o = adapters.table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderstatus"]).withColumn("updated_at", adapters.date_of("o_orderdate"))
    return timeline.changed_entities(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey")


def nearest_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customers nearest to their segment's median balance."""
    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    mid = c.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    away = c.join(F.broadcast(mid), "c_mktsegment").withColumn("away", F.round(F.abs(F.col("c_acctbal") - F.col("m")), 6))
    return relational.latest_by(away, ["c_mktsegment"], [F.asc("away"), F.asc("c_custkey")], 5).select("c_custkey", "c_mktsegment", "away")


def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.companies(spark, sf_dir)
    u = c.select("ticker", (F.col("cik").cast("int") % 3 == 0).alias("is_active"))
    return features.comparison_members(c, u).groupBy("comparison", "member_group").agg(F.count("*").alias("n"))


def trailing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each user's events in the seven days before every day's end: a rolling sum."""
    e = adapters.table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    daily = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("used"))
    w = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return rounded(daily.select("user_id", "day", F.sum("used").over(w).alias("used_7d")), 4)


def tag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as unmapped tags: rows, companies and sectors per factor whose pattern matches."""
    li = adapters.table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"])
    part = adapters.table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    stats = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("cik"), F.col("p_name").alias("tag")).agg(F.count("*").alias("n"))
    patterns = spark.createDataFrame([("colour", "red%"), ("colour", "blue%"), ("kind", "%ring"), ("kind", "%bolt")], "factor string, pattern string")
    return facts.keyword_candidates(stats, patterns, adapters.companies(spark, sf_dir))


def robust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as clipped robust z-scores: the vector normaliser over customers."""
    from tidemark.functions.numbers import robust_z

    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    mid = c.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    scale = c.join(F.broadcast(mid), "c_mktsegment").groupBy("c_mktsegment", "m").agg((F.median(F.abs(F.col("c_acctbal") - F.col("m"))) * 1.4826).alias("s"))
    return rounded(c.join(F.broadcast(scale), "c_mktsegment").select("c_custkey", robust_z(F.col("c_acctbal"), F.col("m"), F.col("s"), 1.5).alias("z")))


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of the last year before its latest, or all where that leaves one."""
    o = adapters.table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderdate"]).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return relational.recent_or_all(o, ["o_custkey"], "o_orderdate", 1)


def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest filings of all suppliers, looked up by number or, for every third, by ticker alone."""
    c = adapters.companies(spark, sf_dir)
    asked = c.select("ticker", F.when(F.col("cik").cast("int") % 3 != 0, F.col("cik")).alias("cik"))
    rows = adapters.instant_series(spark, sf_dir).groupBy("cik", "ticker").agg(F.max("end").alias("end"), F.count("*").alias("n"))
    return relational.by_identity(asked, rows)


def group_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment the customers of the largest balances and those nearest to a threshold."""
    c = adapters.table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    items = c.select("c_mktsegment", F.col("c_custkey").alias("ticker"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("value"), F.lit(1000.0).alias("threshold"))
    told = structure.extremes(items, ["c_mktsegment"])
    return told.select("c_mktsegment", F.concat_ws(",", "outliers").alias("outliers"), F.concat_ws(",", "near_threshold").alias("near_threshold"))


def group_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest suppliers of each nation by balance; every seventh balance is unknown."""
    s = adapters.table(spark, sf_dir, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"])
    return structure.top_members(s.select("s_nationkey", F.col("s_suppkey").alias("ticker"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("market_cap")), ["s_nationkey"])


QUERIES = {f.__name__: f for f in (
    reconstructed_quarters, leading_quarters, resolved_quarters, resolved_periods, merged_segments, mapped_facts, gated_facts, unmapped_tags, fact_upsert, best_candidates, file_changes, annual_consistency, annual_from_quarters, fiscal_regimes, formula_metric, series_issues,
    page_texts, filing_items, filing_exhibits, dividend_phrases, inferred_tags, portfolio_rebalance, portfolio_exposure, core_turnover, share_turnover, core_forward_returns, event_cohorts,
    status_pivot, modal_priority, price_percentiles, segment_shares, unordered_customers, membership_sync, changed_customers, nearest_to_median, comparison_groups,
    trailing_usage, tag_candidates, robust_scores, recent_orders, identity_rows, group_extremes, group_leaders,
)}

_NORMAL = "coalesce(html, '')"
for _p, _by in (
    (r"(?i)<(?:br\s*/?|/(?:p|div|tr|li))>", "chr(10)"), ("<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&quot;", "'\"'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"),
):
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p}', {_by}, 'g')"
_DECODED = r"array_to_string(list_transform(list_zip(string_split_regex(t0, '&#\d+;'), regexp_extract_all(t0, '&#(\d+);', 1)), lambda p: p[1] || coalesce(chr(CAST(p[2] AS INT)), '')), '')"
_SQUEEZED = r"regexp_replace(regexp_replace(replace(replace(t1, chr(13), ''), chr(9), ' '), ' {2,}', ' ', 'g'), '\n{2,}', chr(10), 'g')"
_RANKED = """sold AS (SELECT CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS as_of, p_brand AS name, sum(l_quantity) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY sold DESC, name) AS rank FROM sold)"""
_BANDS = f"""{_RANKED}, core AS (SELECT as_of, list(name ORDER BY rank) AS core FROM ranked WHERE rank <= 5 GROUP BY 1),
chg AS (SELECT *, CASE WHEN before IS NOT NULL THEN 1 - len(list_intersect(core, before)) / len(list_distinct(list_concat(core, before))) END AS turnover FROM (SELECT *, lag(core) OVER (ORDER BY as_of) AS before FROM core)),
pct AS (SELECT quantile_disc(turnover, 0.8) AS p8, quantile_disc(turnover, 0.9) AS p9 FROM chg WHERE turnover IS NOT NULL),
banded AS (SELECT as_of, core, turnover, CASE WHEN turnover > 0 THEN CASE WHEN turnover >= 0.75 OR turnover >= p9 THEN 'regime' WHEN turnover >= 4 / 7 OR turnover >= p8 THEN 'watch' END END AS band FROM chg, pct)"""


def _forward(name: str, members: str, bars: str) -> str:
    return f"""{name}_d AS (SELECT as_of, ticker, months, CAST(date_trunc('month', as_of) + to_months(months) + to_days(CAST(day(as_of) - 1 AS INT)) AS DATE) AS target FROM ({members}), (VALUES (0), (1), (3), (6), (12)) m(months)),
{name}_p AS (SELECT d.*, b.close FROM {name}_d d ASOF JOIN {bars} b ON d.ticker = b.ticker AND d.target <= b.price_date WHERE b.close > 0),
{name} AS (SELECT e.as_of, e.ticker, e.months, e.close / b.close - 1 AS fr FROM {name}_p e JOIN {name}_p b ON e.as_of = b.as_of AND e.ticker = b.ticker AND b.months = 0 WHERE e.months > 0)"""


_CORE_RETURNS = _forward("ret", "SELECT as_of, name AS ticker FROM ranked WHERE rank <= 5", "bars")
_HELD = """held AS (
  SELECT s_nationkey AS portfolio, 'S' || s_suppkey AS ticker, abs(s_acctbal) AS shares, CASE WHEN s_acctbal <> 0 THEN abs(s_acctbal) * 3 / abs(s_acctbal) END AS average_price, abs(s_acctbal) * 3 AS total_cost, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS current_price, CAST(s_suppkey % 4 * 10 AS DOUBLE) AS target_weight FROM supplier
  UNION ALL SELECT DISTINCT s_nationkey, 'CASH', NULL, NULL, CAST(s_nationkey * 1000 + 500 AS DOUBLE), NULL, 5.0 FROM supplier),
valued AS (SELECT *, coalesce(shares * current_price, total_cost, 0) AS current_value FROM held),
weighed AS (SELECT *, current_value / sum(current_value) OVER (PARTITION BY portfolio) * 100 AS current_weight, sum(current_value) OVER (PARTITION BY portfolio) AS total FROM valued)"""

_FACTS = """raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS cik, ['AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'FOB', 'REG'][l_linenumber] AS tag, l_returnflag AS unit, l_orderkey || '-' || l_linenumber AS accn, CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) - 90 END AS start,
  CAST(l_shipdate AS DATE) AS "end", CAST(l_extendedprice AS DOUBLE) AS val, CAST(l_shipdate AS DATE) + 30 AS filed FROM lineitem),
meta(tag, metric_key, fact_type, priority) AS (VALUES ('AIR', 'revenue', 'flow', 1), ('RAIL', 'revenue', 'flow', 99), ('SHIP', 'assets', 'instant', 3))"""

SQL = {
    "recent_orders": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders), r AS (SELECT *, o_orderdate >= max(o_orderdate) OVER (PARTITION BY o_custkey) - INTERVAL 12 MONTH AS recent FROM o)
SELECT o_custkey, o_orderkey, o_orderdate FROM r QUALIFY recent OR sum(CASE WHEN recent THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) <= 1""",
    "identity_rows": f"""WITH {sql.INSTANT}, {sql.COMPANIES.strip()}, a AS (SELECT ticker, CASE WHEN CAST(cik AS INT) % 3 <> 0 THEN cik END AS cik FROM companies), r AS (SELECT cik, ticker, max("end") AS "end", count(*) AS n FROM instant GROUP BY 1, 2)
SELECT a.ticker AS asked_ticker, r.* FROM r JOIN a ON r.cik = a.cik OR (a.cik IS NULL AND r.ticker = a.ticker)""",
    "group_extremes": """WITH i AS (SELECT c_mktsegment, c_custkey AS t, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(v) DESC, t) AS f, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(v - 1000), t) AS n FROM i)
SELECT c_mktsegment, string_agg(CAST(t AS VARCHAR), ',' ORDER BY f) FILTER (f <= 5) AS outliers, string_agg(CAST(t AS VARCHAR), ',' ORDER BY n) FILTER (n <= 5) AS near_threshold FROM r GROUP BY 1""",
    "group_leaders": """SELECT s_nationkey, s_suppkey AS ticker, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS market_cap, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END, -1) DESC, s_suppkey) AS INT) AS place FROM supplier QUALIFY place <= 5""",
    "mapped_facts": f"""WITH {_FACTS} SELECT accn, cik, tag, metric_key, fact_type, CAST(priority AS INT) AS priority, CAST("end" - start + 1 AS INT) AS duration_days, val FROM raw JOIN meta USING (tag)""",
    "gated_facts": f"""WITH {_FACTS}, {sql.COMPANIES.strip()},
gate(tag, metric_key, fact_type, priority, inc, exc) AS (VALUES ('AIR', 'revenue', 'flow', 1, [], ['ASIA']), ('TRUCK', 'revenue', 'flow', 5, ['EUROPE', 'AFRICA'], []), ('MAIL', 'capex_cash', 'flow', 99, [], []), ('REG', 'assets', 'instant', 4, ['AMERICA'], [])),
cs AS (SELECT CAST(CAST(cik AS INT) AS VARCHAR) AS cik, CASE WHEN CAST(cik AS INT) % 9 > 1 THEN sector END AS sector FROM companies)
SELECT accn, raw.cik, tag, metric_key, fact_type, CAST(priority AS INT) AS priority, CAST("end" - start + 1 AS INT) AS duration_days, val FROM raw JOIN gate USING (tag) LEFT JOIN cs ON cs.cik = raw.cik
WHERE CASE WHEN len(inc) > 0 THEN coalesce(list_contains(inc, sector), false) ELSE sector IS NULL OR NOT list_contains(exc, sector) END""",
    "unmapped_tags": f"""WITH {_FACTS} SELECT cik, tag, unit, CASE WHEN start IS NULL THEN 'instant' ELSE 'flow' END AS kind, count(*) AS n, min("end") AS first_end, max("end") AS last_end, max(filed) AS last_filed, arg_max(accn, (filed, "end", accn)) AS accn, any_value(tag) AS label
FROM raw WHERE "end" >= DATE '1994-01-01' AND tag NOT IN (SELECT tag FROM meta) GROUP BY 1, 2, 3, 4""",
    "fact_upsert": f"""WITH {_FACTS} SELECT accn, cik, tag, unit, start, "end", CASE WHEN unit = 'R' THEN val + 1 ELSE val END AS val, CASE WHEN unit = 'R' THEN filed + 400 ELSE filed END AS filed FROM raw""",
    "best_candidates": f"""WITH {_FACTS}, c AS (SELECT cik, metric_key, CAST(date_trunc('quarter', "end") AS DATE) AS period, round(val % 10) / 10 AS score, CAST(priority AS INT) AS priority, filed,
  CASE unit WHEN 'A' THEN 'direct' WHEN 'N' THEN 'cumulative_derived' ELSE 'segment_merged' END AS source_kind, CAST(NULL AS DOUBLE) AS confidence, accn, val FROM raw JOIN meta USING (tag))
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cik, metric_key, period ORDER BY score DESC, priority, filed DESC, CASE source_kind WHEN 'direct' THEN 0 WHEN 'cumulative_derived' THEN 1 ELSE 2 END, accn DESC) = 1""",
    "file_changes": """SELECT o_orderkey AS cik, 'f' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 0""",
    "annual_consistency": f"""WITH {sql.FLOW}, y AS (SELECT cik, metric_key, fiscal_year, sum(val) AS q, count(val) AS n, sum(val) * CASE WHEN CAST(cik AS INT) % 3 = 0 THEN 1.2::DOUBLE ELSE 1.05::DOUBLE END AS v FROM flow WHERE fiscal_year IS NOT NULL GROUP BY 1, 2, 3)
SELECT metric_key, 'annual_differs_from_quarters' AS "check", 'warning' AS severity, count(*) AS n FROM y WHERE n >= 3 AND abs(v - q) > 0.1 * greatest(abs(v), 1e-9) GROUP BY 1""",
    "reconstructed_quarters": f"""WITH {sql.QUARTERS} SELECT s AS cik, 'Revenues' AS tag, 'USD' AS unit, start, "end", round(r, 4) AS val, CAST("end" + 30 AS DATE) AS filed, CAST("end" - start + 1 AS INT) AS duration_days, 'cumulative_derived' AS source_kind
FROM quarters WHERE quarter(start) > 1 AND EXISTS (SELECT 1 FROM q p WHERE p.s = quarters.s AND p.start = quarters.start - INTERVAL 3 MONTH)""",
    "leading_quarters": f"""WITH {sql.QUARTERS} SELECT a.s AS cik, 'Revenues' AS tag, 'USD' AS unit, a.start, a."end", round(a.r, 4) AS val, CAST(b."end" + 30 AS DATE) AS filed, CAST(a."end" - a.start + 1 AS INT) AS duration_days, 'leading_derived' AS source_kind
FROM quarters a JOIN quarters b ON a.s = b.s AND b.start = a.start + INTERVAL 3 MONTH WHERE quarter(a.start) = 1""",
    "resolved_quarters": f"""WITH {sql.QUARTERS},
yw AS (SELECT y, make_date(y, 1, 1) AS low, make_date(y, 12, 31) AS high FROM range(1995, 2002) r(y)),
qw AS (SELECT CAST(y AS INT) AS fiscal_year, k AS fiscal_quarter, CAST(low + 91 * (k - 1) AS DATE) AS low, CAST(CASE WHEN k < 4 THEN low + 91 * k - 1 ELSE high END AS DATE) AS high FROM yw, (VALUES (1), (2), (3), (4)) t(k)),
f AS (SELECT s AS cik, CAST(start + CAST(s % 5 AS INT) AS DATE) AS start, CAST("end" + CAST(s % 5 AS INT) AS DATE) AS "end", r AS val FROM quarters),
c AS (SELECT f.*, qw.*, abs(start - low) AS a, abs("end" - high) AS b, abs(("end" - start) - (high - low)) AS n FROM f, qw WHERE abs(start - low) <= 10 AND abs("end" - high) <= 10 AND "end" - start BETWEEN 74 AND 119),
g AS (SELECT *, 0.35 * (1 - a / 20) + 0.45 * (1 - b / 20) + 0.2 * CASE WHEN n <= 14 THEN 1 - n / 28 ELSE 0 END AS score FROM c)
SELECT cik, start, "end", val, fiscal_year, fiscal_quarter, round(score, 6) AS score, CASE WHEN a = 0 AND b = 0 THEN 'exact' ELSE 'near' END AS match FROM g
QUALIFY row_number() OVER (PARTITION BY cik, start ORDER BY score DESC, fiscal_year, fiscal_quarter) = 1""",
    "resolved_periods": f"""WITH {sql.QUARTERS}, g AS (SELECT *, s + qn AS nn, 'Q' || (qn % 4 + 1) AS label FROM quarters),
f AS (SELECT s AS cik, tag, b AS start, CAST(e AS DATE) AS "end", CASE WHEN nn % 3 > 0 THEN CAST(qn // 4 + CASE WHEN nn % 7 = 0 THEN 1 ELSE 0 END AS INT) END AS fy,
  CASE nn % 4 WHEN 1 THEN label WHEN 2 THEN CASE WHEN qn % 4 = 3 THEN 'FY' ELSE 'Q1' END END AS fp, CASE WHEN qn % 4 = 3 THEN '10-K' ELSE '10-Q' END AS form,
  CASE WHEN nn % 5 = 0 AND tag = 'q' THEN 'CY' || year("end") || label END AS frame
  FROM (SELECT *, 'q' AS tag, start + CAST(s % 5 AS INT) AS b, "end" + CAST(s % 5 AS INT) AS e FROM g UNION ALL SELECT *, 'y', CAST(date_trunc('year', start) AS DATE), "end" + CAST(s % 5 AS INT) FROM g
        UNION ALL SELECT *, 'i', NULL, "end" + CAST(s % 5 * 5 AS INT) FROM g)),
w AS (SELECT y.range AS wy, k.range AS wq, make_date(y.range, 1, 1) AS yl, make_date(y.range, 12, 31) AS yh,
  CASE k.range WHEN 0 THEN make_date(y.range, 1, 1) ELSE make_date(y.range, 1, 1) + CAST((k.range - 1) * 91 AS INT) END AS lo, CASE WHEN k.range IN (0, 4) THEN make_date(y.range, 12, 31) ELSE make_date(y.range, 1, 1) + CAST(k.range * 91 - 1 AS INT) END AS hi
  FROM range(1991, 2001) y, range(5) k),
h AS (SELECT *, "end" - start + 1 AS days, CASE WHEN start IS NULL THEN 'instant' WHEN "end" - start + 1 BETWEEN 330 AND 400 THEN 'annual' WHEN "end" - start + 1 BETWEEN 75 AND 120 THEN 'quarter' WHEN "end" - start + 1 BETWEEN 130 AND 300 THEN 'ytd' ELSE 'other' END AS len,
  CASE WHEN fp LIKE 'Q%' THEN CAST(fp[2] AS INT) END AS fq, CASE WHEN frame LIKE '%Q%' THEN CAST(right(frame, 1) AS INT) END AS rq, row_number() OVER () AS id FROM f),
sc(id, a, b, c, tol, ltol, x) AS (SELECT id, abs(start - lo), abs("end" - hi), abs(("end" - start) - (hi - lo)), CASE wq WHEN 0 THEN 14 ELSE 10 END, CASE wq WHEN 0 THEN 21 ELSE 14 END, {{'wy': wy, 'wq': wq, 'k': 'w', 'inside': start >= lo AND "end" <= hi}} FROM h JOIN w ON abs(wy - coalesce(fy, year("end"))) <= 1
  UNION ALL SELECT id, abs(start - yl), abs("end" - hi), abs(("end" - start) - (hi - yl)), 10, 21, {{'wy': wy, 'wq': wq, 'k': 't', 'inside': start >= yl AND "end" <= hi}} FROM h JOIN w ON wq > 0 AND abs(wy - coalesce(fy, year("end"))) <= 1),
sm AS (SELECT id, x.wy AS wy, x.wq AS wq, x.k AS k, b, 0.35::DOUBLE * CASE WHEN a <= tol THEN 1 - a / (2 * tol) ELSE 0 END + 0.45::DOUBLE * CASE WHEN b <= tol THEN 1 - b / (2 * tol) ELSE 0 END + 0.2::DOUBLE * CASE WHEN c <= ltol THEN 1 - c / (2 * ltol) ELSE 0 END AS s,
  CASE WHEN a = 0 AND b = 0 THEN 'exact' WHEN a <= tol AND b <= tol AND c <= tol THEN 'near' WHEN x.inside THEN 'partial' ELSE 'outside' END AS m FROM sc),
z AS (SELECT sm.*, h.* EXCLUDE (id), w.lo, w.hi, w.yl, round(greatest(0, least(1, s + CASE WHEN fq = sm.wq THEN 0.12 WHEN fq IS NOT NULL THEN -0.2 ELSE 0 END + CASE WHEN rq = sm.wq THEN 0.05 ELSE 0 END)), 9) AS ls,
  coalesce(sm.wq > 1 AND abs(start - yl) <= 2 AND b <= 2, false) AS cum, CASE WHEN b <= 14 THEN 1 - b / 28 ELSE 0 END AS sn,
  round(greatest(0, least(1, CASE WHEN b <= 14 THEN 1 - b / 28 ELSE 0 END + CASE WHEN fy = sm.wy THEN 0.08 ELSE 0 END + CASE WHEN fq = sm.wq THEN 0.08 ELSE 0 END - CASE WHEN fy <> sm.wy OR fq <> sm.wq THEN 0.12 ELSE 0 END)), 9) AS sq
  FROM sm JOIN h USING (id) JOIN w ON w.wy = sm.wy AND w.wq = sm.wq),
ra AS (SELECT id, wy, lo, hi, s, m FROM z WHERE k = 'w' AND wq = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, wy) = 1), rb AS (SELECT id, wy, wq, lo, hi, ls, m, cum FROM z WHERE k = 'w' AND wq > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ls DESC, wy, wq) = 1),
rc AS (SELECT id, wy, wq, yl, hi, s, m FROM z WHERE k = 't' QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, wy, wq) = 1), rd AS (SELECT id, wy, wq, lo, hi, sn, sq, b FROM z WHERE k = 'w' AND wq > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sq DESC, sn DESC, wy, wq) = 1),
e AS (SELECT h.*, CASE WHEN len = 'quarter' THEN 0.35 ELSE 0 END + CASE WHEN form = '10-Q' THEN 0.25 ELSE 0 END + CASE WHEN fq IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN rq IS NOT NULL THEN 0.15 ELSE 0 END AS sure FROM h),
o AS (SELECT e.*, ra.wy AS awy, ra.lo AS alo, ra.hi AS ahi, ra.s AS as_, ra.m AS am, rb.wy AS bwy, rb.wq AS bwq, rb.lo AS blo, rb.hi AS bhi, rb.ls AS bs, rb.m AS bm, rb.cum AS bcum, rc.wy AS cwy, rc.wq AS cwq, rc.yl AS clo, rc.hi AS chi, rc.s AS cs, rc.m AS cm,
  rd.wy AS dwy, rd.wq AS dwq, rd.lo AS dlo, rd.hi AS dhi, rd.sn AS ds, rd.sq AS dq, CASE WHEN rd.b = 0 THEN 'exact' ELSE 'near' END AS dm,
  CASE WHEN (len = 'annual' OR form = '10-K' OR fp = 'FY') AND ra.m IN ('exact', 'near') AND ra.s >= 0.5 THEN 1
    WHEN (len = 'quarter' OR form = '10-Q' OR e.fq IS NOT NULL) AND NOT rb.cum AND ((rb.m IN ('exact', 'near') AND rb.ls >= 0.45) OR (rb.m = 'partial' AND e.days < 170)) THEN 2
    WHEN len = 'quarter' AND e.fy IS NOT NULL AND e.fq IS NOT NULL THEN 3 WHEN len = 'ytd' AND rc.m IN ('exact', 'near') AND rc.s >= 0.4 THEN 4 WHEN len = 'instant' AND rd.sn > 0 THEN 5 WHEN len = 'instant' THEN 6 ELSE 7 END AS way
  FROM e LEFT JOIN ra USING (id) LEFT JOIN rb USING (id) LEFT JOIN rc USING (id) LEFT JOIN rd USING (id))
SELECT cik, tag, start, "end", fy, fp, form, frame, CASE WHEN way = 1 THEN 'annual' WHEN way IN (2, 3) THEN 'quarter' WHEN way = 4 THEN 'ytd' WHEN way IN (5, 6) THEN 'instant' ELSE 'other' END AS kind,
  CAST(CASE way WHEN 1 THEN awy WHEN 2 THEN bwy WHEN 4 THEN cwy WHEN 5 THEN dwy ELSE fy END AS INT) AS fiscal_year, CAST(CASE way WHEN 2 THEN bwq WHEN 3 THEN fq WHEN 4 THEN cwq WHEN 5 THEN dwq WHEN 6 THEN fq END AS INT) AS fiscal_quarter,
  CASE way WHEN 1 THEN alo WHEN 2 THEN blo WHEN 3 THEN start WHEN 4 THEN clo WHEN 5 THEN dlo END AS expected_start, CASE way WHEN 1 THEN ahi WHEN 2 THEN bhi WHEN 3 THEN "end" WHEN 4 THEN chi WHEN 5 THEN dhi WHEN 6 THEN "end" END AS expected_end,
  round(CAST(CASE way WHEN 1 THEN as_ WHEN 2 THEN bs WHEN 3 THEN least(sure, 0.7) WHEN 4 THEN cs WHEN 5 THEN ds WHEN 6 THEN CASE WHEN fy IS NOT NULL AND fq IS NOT NULL THEN 0.65 ELSE 0.45 END ELSE 0.2 END AS DOUBLE), 6) AS fit_score,
  round(CAST(CASE way WHEN 1 THEN as_ WHEN 2 THEN least(1, greatest(bs, sure)) WHEN 3 THEN least(sure, 0.7) WHEN 4 THEN cs WHEN 5 THEN dq WHEN 6 THEN CASE WHEN fy IS NOT NULL AND fq IS NOT NULL THEN 0.65 ELSE 0.45 END ELSE 0.2 END AS DOUBLE), 6) AS confidence,
  CASE way WHEN 1 THEN am WHEN 2 THEN bm WHEN 3 THEN 'exact' WHEN 4 THEN cm WHEN 5 THEN dm ELSE 'unknown' END AS window_match,
  CASE way WHEN 1 THEN 'annual_window' WHEN 2 THEN 'quarter_window' WHEN 3 THEN 'sec_fp' WHEN 4 THEN 'quarter_window' WHEN 5 THEN 'fiscal_profile' WHEN 6 THEN 'instant_snapshot' ELSE 'unresolved' END AS basis FROM o""",
    "merged_segments": """WITH m AS (SELECT l_suppkey AS cik, CAST(date_trunc('month', l_shipdate) AS DATE) AS start, CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS INT) AS accn, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, last_day(start) AS "end", year(start) * 12 + month(start) - row_number() OVER (PARTITION BY cik, accn ORDER BY start) AS g FROM m),
s AS (SELECT cik, accn, min(start) AS start, max("end") AS "end", sum(val) AS val, count(*) AS segments FROM c GROUP BY cik, accn, g)
SELECT *, 'segment_merged' AS source_kind FROM s WHERE segments > 1 AND "end" - start + 1 BETWEEN 75 AND 120""",
    "annual_from_quarters": f"""WITH {sql.FLOW} SELECT cik, metric_key, unit, fiscal_year, round(sum(val), 4) AS val, min(start) AS start, max("end") AS "end", max(effective_date) AS effective_date, 'annual' AS period_type
FROM flow WHERE metric_key IN ('revenue', 'capex_cash') AND fiscal_year IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT fiscal_quarter) = 4 AND count(*) = 4""",
    "fiscal_regimes": f"""WITH {sql.QUARTERS}, y AS (SELECT DISTINCT s, year("end") AS y FROM quarters),
t AS (SELECT s AS cik, y, CASE WHEN s % 3 = 0 AND y >= 1998 THEN 2 ELSE 1 END AS k FROM y)
SELECT cik, CAST(k AS BIGINT) AS regime, CAST(min(y) AS INT) AS first_year, CAST(max(y) AS INT) AS last_year, count(*) AS years FROM t GROUP BY 1, 2""",
    "formula_metric": f"""WITH {sql.FLOW} SELECT a.cik, a.unit, 'capex_incurred' AS metric_key, a."end", a.val + b.val AS val, greatest(a.filed, b.filed) AS filed FROM flow a JOIN flow b USING (cik, unit, "end") WHERE a.metric_key = 'capex_cash' AND b.metric_key = 'dividend_payments'""",
    "series_issues": f"""WITH {sql.FLOW}, f AS (SELECT *, fiscal_year * 4 + fiscal_quarter - 1 AS i FROM flow),
b AS (SELECT cik, metric_key, min(i) AS a, max(i) AS z FROM f GROUP BY 1, 2),
prof AS (SELECT cik, metric_key, count(*) >= 5 AND avg((val > 0)::INT) >= 0.9 AS positive FROM flow GROUP BY 1, 2),
issues AS (
  SELECT cik, metric_key, 'missing_fiscal_year' AS "check", 'warning' AS severity FROM f WHERE fiscal_year IS NULL
  UNION ALL SELECT cik, metric_key, 'missing_fiscal_quarter', 'warning' FROM f WHERE fiscal_quarter IS NULL
  UNION ALL SELECT cik, metric_key, 'missing_quarter', 'warning' FROM (SELECT b.cik, b.metric_key, unnest(range(a, z + 1)) AS i FROM b) w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cik = w.cik AND f.metric_key = w.metric_key AND f.i = w.i)
  UNION ALL SELECT cik, metric_key, CASE WHEN positive THEN 'sign_profile_conflict' ELSE 'negative_value' END, CASE WHEN positive THEN 'warning' ELSE 'info' END FROM f JOIN prof USING (cik, metric_key) WHERE val < 0)
SELECT metric_key, "check", severity, count(*) AS n, count(DISTINCT cik) AS companies FROM issues GROUP BY 1, 2, 3""",
    "page_texts": f"""WITH a AS (SELECT page_id, {_NORMAL} AS t0 FROM pages), b AS (SELECT page_id, {_DECODED} AS t1 FROM a), c AS (SELECT page_id, {_SQUEEZED} AS t2 FROM b), d AS (SELECT page_id, regexp_replace(t2, '^\\s+|\\s+$', '', 'g') AS t FROM c)
SELECT page_id, CAST(length(t) AS INT) AS chars, md5(t) AS digest FROM d""",
    "filing_items": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS f, o_orderkey % 90 + 10 AS k FROM orders)
SELECT o_orderkey, 0 AS pos, '5.02' AS code, 'Departure of Officer ' || k AS title, 'First body' AS body FROM o WHERE f = 0
UNION ALL SELECT o_orderkey, 1, '9.01', 'Exhibits', '(d) Exhibits' || chr(10) || '99.1. Release ' || k || '.' || chr(10) || '101.INS Instance' || chr(10) || '(e) Other' || chr(10) || '5 not one' FROM o WHERE f = 0
UNION ALL SELECT o_orderkey, 0, '1A', 'Risk Factors', 'risk ' || k FROM o WHERE f = 1
UNION ALL SELECT o_orderkey, 1, '7', 'Discussion', 'of items' || chr(10) || 'and more' FROM o WHERE f = 1
UNION ALL SELECT o_orderkey, 0, '2.02', 'Results', 'quarter ' || k || chr(10) || 'Exhibit No.  Description' || chr(10) || '10.1 Contract ' || k || chr(10) || '10.1 Contract ' || k || chr(10) || 'no 7' FROM o WHERE f = 2""",
    "filing_exhibits": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS f, o_orderkey % 90 + 10 AS k FROM orders)
SELECT o_orderkey, 0 AS pos, '99.1' AS number, 'Release ' || k AS description FROM o WHERE f = 0 UNION ALL SELECT o_orderkey, 1, '101.INS', 'Instance' FROM o WHERE f = 0
UNION ALL SELECT o_orderkey, 0, '10.1', 'Contract ' || k FROM o WHERE f = 2""",
    "dividend_phrases": """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS f, o_orderkey % 90 + 10 AS k, o_orderkey % 28 + 1 AS d FROM orders)
SELECT o_orderkey, CASE WHEN f = 1 THEN k / 100 END AS previous, CASE WHEN f = 1 THEN CAST('1.' || k AS DOUBLE) END AS current, CASE WHEN f = 2 THEN CAST('2.' || k AS DOUBLE) END AS annualized,
  CASE WHEN f = 2 THEN 'May ' || d || ', 2024' END AS declared, CASE WHEN f = 2 THEN 'June ' || d || ', 2024' END AS record,
  CASE f WHEN 1 THEN 'March ' || d || ', 2024' WHEN 3 THEN 'July ' || d || ', 2024' END AS payable, f = 0 AS is_silent FROM o""",
    "inferred_tags": f"""WITH {sql.COMPANIES.strip()}, t AS (SELECT cik, CAST(cik AS INT) AS k FROM companies)
SELECT cik, array_to_string(list_filter(list_concat(
  CASE k % 4 WHEN 0 THEN ['tech'] WHEN 1 THEN ['energy'] ELSE [] END, CASE k % 3 WHEN 0 THEN ['software'] WHEN 1 THEN ['oil_gas'] ELSE ['banking'] END,
  CASE k % 5 WHEN 0 THEN ['us_listed'] WHEN 1 THEN ['non_us', 'china_exposure'] WHEN 2 THEN [] WHEN 3 THEN ['non_us'] ELSE ['us_listed'] END, CASE WHEN k % 7 = 0 THEN ['etf'] ELSE [] END,
  CASE k % 5 WHEN 0 THEN ['data_center', 'cloud'] WHEN 1 THEN ['power_infra'] WHEN 2 THEN ['ai', 'consumer'] ELSE [] END,
  [CASE k % 5 WHEN 4 THEN 'megacap' WHEN 3 THEN 'largecap' WHEN 2 THEN 'largecap' ELSE 'smallcap' END,
   CASE WHEN k % 10 < 3 THEN 'low_beta' WHEN k % 10 <= 7 THEN 'mid_beta' ELSE 'high_beta' END, CASE k % 6 WHEN 0 THEN 'non_dividend' WHEN 1 THEN 'low_dividend' WHEN 2 THEN 'mid_dividend' WHEN 3 THEN 'mid_dividend' WHEN 4 THEN 'mid_dividend' ELSE 'high_dividend' END]
  ), lambda x: x IS NOT NULL), ',') AS tags FROM t""",
    "portfolio_rebalance": f"""WITH {_HELD},
c AS (SELECT *, max(CASE WHEN ticker = 'CASH' THEN greatest(current_value - target_weight / 100 * total, 0) END) OVER (PARTITION BY portfolio) AS investable, CASE WHEN ticker <> 'CASH' THEN greatest(coalesce(target_weight, 0) / 100 * total - current_value, 0) END AS deficit_value FROM weighed),
b AS (SELECT *, CASE WHEN ticker = 'CASH' THEN -investable WHEN sum(deficit_value) OVER (PARTITION BY portfolio) > 0 AND investable > 0 THEN deficit_value / sum(deficit_value) OVER (PARTITION BY portfolio) * investable ELSE 0 END AS buy_amount FROM c)
SELECT portfolio, ticker, round(shares, 6) AS shares, round(average_price, 6) AS average_price, round(total_cost, 6) AS total_cost, current_price, target_weight, round(current_value, 6) AS current_value, round(current_weight, 6) AS current_weight, round(deficit_value, 6) AS deficit_value,
  round(buy_amount, 6) AS buy_amount, round(current_weight - target_weight, 6) AS weight_gap, round(CASE WHEN ticker <> 'CASH' AND buy_amount > 0 THEN buy_amount / current_price END, 6) AS buy_shares FROM b""",
    "portfolio_exposure": f"""WITH {_HELD}, {sql.COMPANIES.strip()}, j AS (SELECT portfolio, current_weight, sector, industry, CAST(cik AS INT) AS k FROM weighed JOIN companies USING (ticker)),
u AS (SELECT portfolio, 'sector' AS kind, sector AS name, current_weight FROM j UNION ALL SELECT portfolio, 'industry', industry, current_weight FROM j UNION ALL SELECT portfolio, 'tags', lower(sector), current_weight FROM j UNION ALL SELECT portfolio, 'tags', 'even', current_weight FROM j WHERE k % 2 = 0)
SELECT portfolio, kind, name, round(sum(current_weight), 6) AS weight FROM u GROUP BY 1, 2, 3""",
    "core_turnover": f"WITH {_BANDS} SELECT as_of, array_to_string(core, ',') AS core, round(turnover, 6) AS turnover, band FROM banded",
    "share_turnover": f"""WITH {_RANKED}, s AS (SELECT as_of, name, sold / sum(sold) OVER (PARTITION BY as_of) AS x FROM ranked WHERE rank <= 10),
l AS (SELECT last_day(as_of + INTERVAL 3 MONTH) AS as_of, name, x FROM s)
SELECT as_of, round(1 - sum(least(coalesce(l.x, 0), coalesce(s.x, 0))) / sum(greatest(coalesce(l.x, 0), coalesce(s.x, 0))), 6) AS turnover FROM s FULL JOIN l USING (as_of, name) GROUP BY 1""",
    "core_forward_returns": f"WITH {_RANKED}, {sql.BARS.strip()}, {_CORE_RETURNS} SELECT as_of, months, count(*) AS n, round(avg(fr), 6) AS mean, round(median(fr), 6) AS median FROM ret GROUP BY 1, 2",
    "event_cohorts": f"""WITH {_BANDS}, {sql.BARS.strip()}, {sql.SPY.strip()}, {_CORE_RETURNS}, {_forward('bm', "SELECT DISTINCT as_of, 'SPY' AS ticker FROM ranked", 'spy')},
m AS (SELECT as_of, months, avg(fr) AS mean FROM ret GROUP BY 1, 2)
SELECT band IS NOT NULL AS is_event, m.months, count(*) AS snapshots, round(avg(mean), 6) AS mean, round(median(mean), 6) AS median, round(avg(mean - bm.fr), 6) AS excess
FROM m JOIN banded USING (as_of) LEFT JOIN bm ON bm.as_of = m.as_of AND bm.months = m.months GROUP BY 1, 2""",
    "status_pivot": """SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS max_f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS max_o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS max_p, count(DISTINCT o_orderpriority) AS priorities,
  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS finished_priorities, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest_order FROM orders GROUP BY 1""",
    "modal_priority": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) = 1""",
    "price_percentiles": """WITH m AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderstatus) AS md FROM orders)
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.8), 4) AS p80, round(quantile_disc(o_totalprice, 0.8), 4) AS p80_rank, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd_sample, round(stddev_pop(o_totalprice), 4) AS sd_population,
  round(median(abs(o_totalprice - md)) * 1.4826, 4) AS mad_scale FROM m GROUP BY 1""",
    "segment_shares": "SELECT c_mktsegment AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1 ORDER BY n DESC, name LIMIT 3",
    "unordered_customers": "SELECT c_custkey, n_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer LEFT JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey",
    "membership_sync": """SELECT c_mktsegment AS universe_key, 'C' || c_custkey AS ticker, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal > 2000 ELSE true END AS is_active FROM customer WHERE c_acctbal < 6000 OR (c_mktsegment = 'BUILDING' AND c_acctbal > 2000)""",
    "changed_customers": """WITH i AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS input_at FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS output_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, input_at, output_at FROM i LEFT JOIN o USING (o_custkey) WHERE output_at IS NULL OR input_at > output_at""",
    "nearest_to_median": """WITH m AS (SELECT *, round(abs(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment)), 6) AS away FROM customer)
SELECT c_custkey, c_mktsegment, away FROM m QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY away, c_custkey) <= 5""",
    "comparison_groups": f"""WITH {sql.COMPANIES.strip()} SELECT 'all' AS comparison, 'all' AS member_group, count(*) AS n FROM companies UNION ALL SELECT 'universe', 'universe', count(*) FROM companies WHERE CAST(cik AS INT) % 3 = 0 UNION ALL SELECT 'sector', sector, count(*) FROM companies GROUP BY sector""",
    "trailing_usage": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS used FROM events GROUP BY 1, 2)
SELECT user_id, day, round(sum(used) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS used_7d FROM d""",
    "tag_candidates": f"""WITH {sql.COMPANIES.strip()}, p(factor, pattern) AS (VALUES ('colour', 'red%'), ('colour', 'blue%'), ('kind', '%ring'), ('kind', '%bolt')),
s AS (SELECT l_suppkey, p_name AS tag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT factor, tag, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT l_suppkey) AS companies, count(DISTINCT sector) AS sectors FROM s JOIN p ON tag ILIKE pattern LEFT JOIN companies ON CAST(cik AS BIGINT) = l_suppkey GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY factor ORDER BY companies DESC, rows DESC, tag) <= 25""",
    "robust_scores": """WITH m AS (SELECT *, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS md FROM customer), s AS (SELECT *, median(abs(c_acctbal - md)) OVER (PARTITION BY c_mktsegment) * 1.4826 AS sc FROM m)
SELECT c_custkey, round(CASE WHEN sc > 0 THEN least(greatest((c_acctbal - md) / sc, -1.5), 1.5) ELSE 0 END, 6) AS z FROM s""",
}
