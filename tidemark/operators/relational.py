"""Latest-by, as-of joins and keyed replacement: the relational idioms every other operator rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key under ``order``; every tie-break has to be in ``order``.

    A limit on a row number lets Spark drop rows before the shuffle (WindowGroupLimit), so a
    key with a third of all rows sends few of them to its task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def winner_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` columns of each key, by a partial aggregate: no sort and less shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """An upsert's result: of rows with equal keys (nulls equal) the one of the largest ``ordinal``."""
    return winner_by(df, keys, [ordinal])


def replace_slice(stored: DataFrame, fresh: DataFrame, slice_keys: Sequence[str]) -> DataFrame:
    """``stored`` with every slice that ``fresh`` names replaced by the rows of ``fresh``.

    Null-safe on the keys. The slices named are distinct keys of the fresh rows.
    """
    named = fresh.select(*[F.col(k).alias(f"__{k}") for k in slice_keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in slice_keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return stored.join(named, condition, "left_anti").unionByName(fresh, allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, prefix: str = "", tie: Sequence[str] = ()) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` whose date isn't after its own.

    Both sides are put in one stream per key and the last right row is carried forward, so
    the work is linear whatever the number of matches (a range join would be quadratic in a
    hot key). Equal dates match; of right rows on one date the largest by ``tie`` counts.
    Right columns get ``prefix``; they are null where nothing came before.
    """
    rest = [c for c in right.columns if c not in keys]
    l = left.select(*keys, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*rest).alias("r")).schema["r"].dataType).alias("__r"))
    tied = F.struct(*tie) if tie else F.lit(0)
    r = right.select(*keys, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*rest).alias("__r"), tied.alias("__tie"))
    l = l.withColumn("__tie", F.lit(None).cast(r.schema["__tie"].dataType))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", F.col("__tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).where(F.col("__at").isNotNull() | (F.col("__side") == 1))
    carried = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return carried.select("__l.*", *[F.when(F.col("__at").isNotNull(), F.col("__m")[c]).alias(prefix + c) for c in rest])


def first_on_or_after(dates: DataFrame, bars: DataFrame, keys: Sequence[str], date: str, bar_date: str, value: str) -> DataFrame:
    """Per row of ``dates`` (keys, date) the first bar on or after it: adds bar_date and value.

    A bar whose value isn't above 0 is picked all the same and then dropped with its row:
    the key is lost for that date, it doesn't move on to the next bar.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    l = dates.select(*keys, F.col(date).alias("__at"), F.lit(1).alias("__side"), F.struct(*dates.columns).alias("__l"))
    r = bars.select(*keys, F.col(bar_date).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(bar_date).alias("d"), F.col(value).cast("double").alias("v")).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(order)).where("__side = 1 and __m.v > 0")
    return found.select("__l.*", F.col("__m.d").alias(bar_date), F.col("__m.v").alias(value))


def bitemporal_latest(rows: DataFrame, snapshots: DataFrame, keys: Sequence[str], period: str = "end", known: str = "effective_date", as_of_date: str = "as_of") -> DataFrame:
    """For every snapshot the row of each key that was known by then, latest by (known, period).

    ``snapshots`` (as_of) is a small list of dates. Each row is turned into the interval in
    which it is the latest (until the next row of its key becomes known), and only then
    matched with the snapshots inside it: rows are never multiplied by snapshots.
    """
    w = Window.partitionBy(*keys).orderBy(known, period)
    spans = rows.withColumn("__until", F.lead(known).over(w))
    match = (F.col(as_of_date) >= F.col(known)) & (F.col("__until").isNull() | (F.col(as_of_date) < F.col("__until")))
    return spans.join(F.broadcast(snapshots.select(as_of_date).distinct()), match).drop("__until")


def recent_or_all(rows: DataFrame, keys: list[str], date: str, years: int) -> DataFrame:
    """The rows of each key's last ``years`` years up to its latest date; all of a key's rows where that would leave one or none."""
    own = Window.partitionBy(*keys)
    recent = F.col(date) >= F.add_months(F.max(date).over(own), -12 * years)
    marked = rows.withColumn("__recent", F.coalesce(recent, F.lit(False)))
    return marked.withColumn("__n", F.sum(F.col("__recent").cast("int")).over(own)).where(F.col("__recent") | (F.col("__n") <= 1)).drop("__recent", "__n")


def by_identity(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each asked (ticker, cik): by cik, or by ticker where the asked one has no cik. Adds asked_ticker.

    Two equality joins over disjoint parts of ``asked``, so neither side is compared with all of the other.
    """
    known = asked.where("cik is not null").select(F.col("ticker").alias("asked_ticker"), "cik").distinct()
    unknown = asked.where("cik is null").select(F.col("ticker").alias("asked_ticker"), "ticker").distinct()
    names = ["asked_ticker", *rows.columns]
    return rows.join(known, "cik").select(*names).unionByName(rows.join(unknown, "ticker").select(*names))
