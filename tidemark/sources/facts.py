"""Readers and keyed writers: company facts as JSON, submissions, holdings, macro observations, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.filings import is_ticker_like, padded_cik, ticker
from tidemark.operators.relational import last_wins, replace_slice
from tidemark.session import if_small

POINT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
COMPANY = f"cik string, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<{POINT}>>>>>"
SUBMISSION = "cik string, filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>>"


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company-facts documents, one JSON object a file; fields of a wrong type are null."""
    return spark.read.schema(COMPANY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def flatten(companies: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """One row per fact: taxonomy, tag, unit and point exploded; an allow-list of tags is applied before points are."""
    t = companies.select(padded_cik(F.col("cik")).alias("cik"), F.col("entityName").alias("entity_name"), F.explode("facts").alias("taxonomy", "tags"))
    g = t.select("cik", "entity_name", "taxonomy", F.explode("tags").alias("tag", "body"))
    if tags:
        g = g.where(F.col("tag").isin(*tags))
    u = g.select("cik", "entity_name", "taxonomy", "tag", "body.label", "body.description", F.explode("body.units").alias("unit", "points"))
    p = u.withColumn("p", F.explode("points"))
    day = lambda c: F.col(f"p.{c}").try_cast("date").alias(c)
    return p.select(
        "cik", "entity_name", "taxonomy", "tag", "unit", "label", "description", "p.val", day("start"), day("end"), "p.accn", "p.fy", "p.fp", "p.form", day("filed"), "p.frame"
    )


FACT_KEY = ["cik", "taxonomy", "tag", "unit", "accn", "start", "end"]


def upsert_facts(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Stored and fresh facts with one row per key; fresh ones win, of two fresh ones the later filed."""
    told = fresh.withColumn("__o", F.struct(F.lit(1).alias("a"), F.col("filed"), F.col("val")))
    if stored is not None:
        told = stored.withColumn("__o", F.struct(F.lit(0).alias("a"), F.col("filed"), F.col("val"))).unionByName(told)
    return last_wins(told, FACT_KEY, "__o").drop("__o")


def changed_files(listing: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """(cik, path, size, change): files that are new or whose size differs from the stored one; all with ``force``."""
    told = listing.join(state.select("cik", F.col("size").alias("__s")), "cik", "left")
    change = F.when(F.col("__s").isNull(), "new").when(F.col("__s") != F.col("size"), "changed").otherwise("same")
    told = told.withColumn("change", change).drop("__s")
    return told if force else told.where("change <> 'same'")


def facts_of(facts: DataFrame, cik: str | None = None, tags: list[str] | None = None, unit: str | None = None, forms: list[str] | None = None) -> DataFrame:
    """Facts with a value and an end, by optional filters that reach the scan; no filter is emitted for an absent argument."""
    told = facts.where("val is not null and end is not null")
    for column, wanted in (("cik", [cik] if cik else None), ("tag", tags), ("unit", [unit] if unit else None), ("form", forms)):
        if wanted:
            told = told.where(F.col(column).isin(*wanted))
    return told


def map_tags(facts: DataFrame, tag_meta: DataFrame, default_priority: int = 99) -> DataFrame:
    """Facts of known tags with their metric, fact type, priority and length. ``tag_meta`` is a registry of a few hundred rows."""
    known = facts.where("val is not null and end is not null").join(if_small(tag_meta), "tag")
    return known.withColumn("priority", F.coalesce("priority", F.lit(default_priority))).withColumn("duration_days", F.date_diff("end", "start") + 1)


def gate_by_sector(mapped: DataFrame, companies: DataFrame) -> DataFrame:
    """Mapped facts whose tag is open to their company's sector; the registry's gate columns go.

    ``mapped``: facts after :func:`map_tags` by a registry with enabled, include_sectors and exclude_sectors. A tag that
    isn't enabled is closed. One that names sectors to include is open to these only, so not to a company of unknown or blank
    sector; else it is open but to the sectors it excludes. ``companies``: (cik, sector), a row each; spaces around a sector don't count.
    """
    known = companies.select("cik", F.trim("sector").alias("__sector"))
    told = mapped.join(if_small(known), "cik", "left")
    own = F.coalesce("__sector", F.lit(""))
    named = F.coalesce(F.size("include_sectors") > 0, F.lit(False))
    inside = F.coalesce(F.array_contains("include_sectors", own), F.lit(False)) & (own != "")
    outside = F.coalesce(F.array_contains("exclude_sectors", own), F.lit(False)) & (own != "")
    open_ = F.coalesce("enabled", F.lit(False)) & F.when(named, inside).otherwise(~outside)
    return told.where(open_).drop("__sector", "enabled", "include_sectors", "exclude_sectors")


def unmapped_tag_stats(facts: DataFrame, tag_meta: DataFrame, since: str = "2018-01-01") -> DataFrame:
    """Per company, tag, unit and kind of unmapped tags: rows, first and last end, and the newest accession and label."""
    rest = facts.where(F.col("end") >= F.lit(since).cast("date")).join(if_small(tag_meta.select("tag")), "tag", "left_anti")
    kind = F.when(F.col("start").isNull(), "instant").otherwise("flow")
    return rest.groupBy("cik", "tag", "unit", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.min("end").alias("first_end"), F.max("end").alias("last_end"), F.max("filed").alias("last_filed"),
        F.max_by(F.struct("accn", "label", "description"), F.struct("filed", "end", "accn")).alias("newest"),
    ).select("*", "newest.*").drop("newest")


def keyword_candidates(stats: DataFrame, patterns: DataFrame, companies: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` commonest unmapped tags per factor whose name matches one of its patterns (factor, pattern)."""
    from tidemark.operators.relational import latest_by

    met = stats.join(F.broadcast(patterns), F.expr("tag ilike pattern")).join(companies.select("cik", "sector"), "cik", "left")
    counted = met.groupBy("factor", "tag").agg(F.sum("n").alias("rows"), F.countDistinct("cik").alias("companies"), F.countDistinct("sector").alias("sectors"))
    return latest_by(counted, ["factor"], [F.desc("companies"), F.desc("rows"), F.asc("tag")], n)


def read_submissions(spark: SparkSession, path: str, forms: list[str], since: str) -> DataFrame:
    """Recent filings: parallel arrays zipped by position, of the forms and days wanted."""
    raw = spark.read.schema(SUBMISSION).option("multiLine", True).json(path)
    zipped = raw.select(padded_cik(F.col("cik")).alias("cik"), F.explode(F.arrays_zip("filings.recent.accessionNumber", "filings.recent.filingDate", "filings.recent.form", "filings.recent.primaryDocument")).alias("f"))
    told = zipped.select("cik", F.col("f.accessionNumber").alias("accn"), F.col("f.filingDate").try_cast("date").alias("filed"), F.col("f.form").alias("form"), F.col("f.primaryDocument").alias("document"))
    return told.where(F.col("form").isin(*forms) & (F.col("filed") >= F.lit(since).cast("date")))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Macro observations from CSV (series_id, observation_date, value); a full stop is a missing value."""
    raw = spark.read.schema("series_id string, observation_date string, value string").option("header", True).csv(path)
    return raw.select("series_id", F.col("observation_date").try_cast("date").alias("observation_date"), F.col("value").try_cast("double").alias("value"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header; rows without a date or with a close that isn't a number above 0 are dropped."""
    raw = spark.read.schema("ticker string, price_date string, open string, high string, low string, close string, volume string").option("header", True).csv(path)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    told = raw.select(ticker(F.col("ticker")).alias("ticker"), F.col("price_date").try_cast("date").alias("price_date"), *map(number, ("open", "high", "low", "close")), F.col("volume").try_cast("long").alias("volume"))
    return told.where("price_date is not null and close > 0")


def read_holdings(spark: SparkSession, path: str, header: str = "Ticker") -> DataFrame:
    """Fund holdings from CSV files whose table follows some lines of preamble: (ticker, name, weight).

    A file is one fund's list, a few hundred lines, and is split as one value. Fields may be quoted.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.split("value", r"\r?\n").alias("l")).withColumn("h", F.expr(f"array_position(transform(l, x -> x like '%{header}%,%' or x like '{header},%'), true)")).where("h > 0")
    rows = lines.select(F.get("l", F.col("h").cast("int") - 1).alias("head"), F.explode(F.expr("slice(l, cast(h as int) + 1, size(l))")).alias("row"))
    cut = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r'("[^"]*"|[^,]*)(?:,|$)'), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    at = lambda name: F.get(cut(F.col("row")), F.array_position(F.transform(cut(F.col("head")), lambda x: F.lower(x)), name).cast("int") - 1)
    told = rows.select(ticker(at("ticker")).alias("ticker"), at("name").alias("name"), F.regexp_replace(at("weight"), "[%,]", "").try_cast("double").alias("weight"))
    return told.where(is_ticker_like(F.col("ticker")))


def sync_memberships(stored: DataFrame, holdings: DataFrame, universe: str) -> DataFrame:
    """A universe's members: those in ``holdings`` active, those stored before inactive; other universes as they are."""
    old = stored.where(F.col("universe_key") == universe).select("ticker").withColumn("__old", F.lit(True))
    new = holdings.select("ticker").distinct().withColumn("is_active", F.lit(True))
    told = old.join(new, "ticker", "full").select(F.lit(universe).alias("universe_key"), "ticker", F.coalesce("is_active", F.lit(False)).alias("is_active"))
    return replace_slice(stored, told, ["universe_key"])


def profile_rows(raw: DataFrame) -> DataFrame:
    """Vendor profiles cleaned: blank text is null, numbers are coerced."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return raw.select(ticker(F.col("ticker")).alias("ticker"), *map(text, ("company_name", "sector", "industry", "country", "description")), *map(number, ("market_cap", "beta", "last_dividend", "price")))


def write_keyed(df: DataFrame, path: str, partition: str) -> None:
    """Write by partition, replacing only the partitions that ``df`` has: a delete and insert of slices."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def stale_candidates(memberships: DataFrame, fetched: dict[str, DataFrame], universes: list[str], before: str, n: int | None = None) -> DataFrame:
    """Active members of the universes that lack one of the vendor's tables, or whose oldest fetch is before a day: (ticker, missing, oldest_fetch).

    ``fetched``: tables (ticker, fetched_at), one row a ticker; a null date is a row never fetched. Those that lack something come
    first, then the oldest; ``n`` limits the list to what one run will fetch.
    """
    told = memberships.where(F.col("universe_key").isin(*universes) & F.col("is_active")).select("ticker").distinct()
    for name, rows in fetched.items():
        told = told.join(rows.select("ticker", F.col("fetched_at").alias(f"__{name}"), F.lit(True).alias(f"__has_{name}")), "ticker", "left")
    epoch = F.lit("1970-01-01").cast("date")
    oldest = F.least(*[F.coalesce(F.col(f"__{name}").cast("date"), epoch) for name in fetched], F.lit("9999-12-31").cast("date"))
    missing = F.exists(F.array(*[F.col(f"__has_{name}").isNull() for name in fetched]), lambda x: x)
    some = told.select("ticker", missing.alias("missing"), oldest.alias("oldest_fetch")).where(F.col("missing") | (F.col("oldest_fetch") < F.lit(before).cast("date")))
    return some.orderBy(F.desc("missing"), "oldest_fetch", "ticker").limit(n) if n else some
