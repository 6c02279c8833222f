"""Fiscal profiles as they are kept: a nested row for each company in a table that runs update and read windows from.

A row holds a company's profile, its years and quarters as arrays, the usual lengths of its quarters, and its regimes as
JSON text. Windows come out of the table without a look at the facts (:meth:`ProfileStore.calendar`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fiscal
from tidemark.session import discard, if_small, materialize

PROFILE = (
    "earliest_year int, latest_year int, anchor_start date, anchor_end date, end_month int, end_day int, regime_kind string, regime_start int, regime_end int, "
    "is_week_based boolean, end_weekday int, has_53_weeks boolean, annual_days int, accn string, filed date"
)
YEAR = "fiscal_year int, start date, end date, days int, accn string, filed date, is_transition boolean, is_anchor boolean"
QUARTER = "fiscal_year int, fiscal_quarter int, start date, end date, days int, source string, accn string, filed date"
LENGTH = "fiscal_quarter int, least_days int, most_days int, n long, usual_days int, usual_start string, usual_end string"
REGIME = (
    "regime long, start_year int, end_year int, end_month int, end_day int, kind string, end_weekday int, has_53_weeks boolean, usual_days int, "
    "confidence double, transition_years array<int>"
)
#: The kinds of a regime; a stored one of another kind isn't read.
KINDS = ("calendar_month_end", "fiscal_month_end", "week_52_53", "transition")


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


def nest(profiles: DataFrame, annual: DataFrame, quarters: DataFrame, lengths: DataFrame, regimes: DataFrame) -> DataFrame:
    """One row per company of ``profiles``: its columns, annual_periods, quarter_periods, quarter_lengths, regimes (JSON).

    Arguments as :mod:`fiscal` makes them. A company has a few rows for each year, so its arrays are short. They are
    sorted, so equal rows in any order make the same value; a company without quarters has empty arrays.
    """
    told = profiles.select("cik", *[F.col(n) for n in _names(PROFILE)])
    for name, rows, fields in (("annual_periods", annual, YEAR), ("quarter_periods", quarters, QUARTER), ("quarter_lengths", lengths, LENGTH), ("__regimes", regimes, REGIME)):
        kind = f"array<{_struct(fields)}>"
        held = rows.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct(*_names(fields)).cast(_struct(fields)))).alias(name))
        told = told.join(held, "cik", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return told.select("*", F.to_json("__regimes").alias("regimes")).drop("__regimes")


def profile(facts: DataFrame) -> DataFrame:
    """Nested profiles of all companies, straight from their facts. What has no fiscal year has no profile."""
    annual = materialize(fiscal.annual_periods(facts), "annual")
    quarters = materialize(fiscal.quarter_periods(annual, fiscal.quarter_candidates(facts)), "quarters")
    history = materialize(fiscal.regime_history(annual), "regimes")
    return nest(fiscal.profiles(annual, history), annual, quarters, fiscal.quarter_lengths(quarters), history)


def regimes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regimes of stored rows, and the texts that couldn't be read: (cik, text).

    Text that is null, no JSON or no array tells no regime and is reported unless null. An item without a number, first
    year or known kind is dropped; so is one of a type that doesn't fit.
    """
    parsed = rows.select("cik", F.col("regimes").alias("text"), F.try_variant_get(F.try_parse_json("regimes"), "$", "array<variant>").alias("v"))
    item = parsed.select("cik", F.explode("v").alias("v")).select("cik", F.try_variant_get("v", "$", _struct(REGIME)).alias("r")).select("cik", "r.*")
    known = item.where(F.col("regime").isNotNull() & F.col("start_year").isNotNull() & F.col("kind").isin(*KINDS))
    return known, parsed.where("text is not null and v is null").select("cik", "text")


def periods(rows: DataFrame, which: str) -> DataFrame:
    """The rows of an array of stored ones: annual_periods, quarter_periods or quarter_lengths."""
    return rows.select("cik", F.explode(which).alias("p")).select("cik", "p.*")


class ProfileStore:
    """Nested profiles in a folder, partitioned by a hash of the company, so that a company's row is in one small partition.

    An update writes the partitions of companies that are new or whose row changed, and no others; companies that it
    doesn't name stay. Partitions are replaced when the whole write is committed; one writer at a time.
    """

    SCHEMA = f"cik string, {PROFILE}, annual_periods array<{_struct(YEAR)}>, quarter_periods array<{_struct(QUARTER)}>, quarter_lengths array<{_struct(LENGTH)}>, regimes string, mark long, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, companies: list[str] | None = None) -> DataFrame:
        """All stored rows, or those of some companies, for which only their partitions are read."""
        there = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._at)
        told = self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)
        if companies is not None:
            told = told.where(F.col("cik").isin(*companies) & F.col("bucket").isin(*[self._bucket(F.lit(c)) for c in companies])) if companies else told.limit(0)
        return told.drop("bucket", "mark")

    def update(self, profiles: DataFrame) -> int:
        """Store nested ``profiles``, one row a company; returns how many were new or changed. Companies are kept as text."""
        profiles = profiles.withColumn("cik", F.col("cik").cast("string")).where("cik is not null")
        names = ["cik", *_names(PROFILE), "annual_periods", "quarter_periods", "quarter_lengths", "regimes"]
        mark = F.xxhash64(F.to_json(F.struct(*names)))
        given = profiles.select(*names, mark.alias("mark"), self._bucket(F.col("cik")).alias("bucket"))
        there = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._at)
        old = self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)
        fresh = materialize(given.join(old.select("cik", "mark"), ["cik", "mark"], "left_anti"), "fresh-profiles")
        n = fresh.count()
        if n:
            touched = old.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")
            kept = touched.join(if_small(fresh.select("cik")), "cik", "left_anti")
            # written apart first: the partitions to be replaced are those that are read
            merged = materialize(kept.select(*old.columns).unionByName(fresh.select(*old.columns)), "merged-profiles")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            discard(merged)
        discard(fresh)
        return n

    def calendar(self, companies: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Year and quarter windows as :func:`fiscal.calendar` tells them, from what is stored."""
        rows = self.rows(companies)
        years = fiscal.year_windows(periods(rows, "annual_periods"), regimes(rows)[0], rows.select("cik", *_names(PROFILE)))
        return years, fiscal.quarter_windows(years, periods(rows, "quarter_periods"), periods(rows, "quarter_lengths"))
