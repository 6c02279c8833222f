"""Trading sessions as a relation: one row a session with its ordinal, so that counting sessions is arithmetic on ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import market_holidays, weekday

#: Minutes of the New York day at which sessions open, close, and close early.
OPENS, CLOSES, CLOSES_EARLY, ZONE = 570, 960, 780, "America/New_York"


def _closes_early(day: Column) -> Column:
    """The day before Independence Day, the day after Thanksgiving and Christmas Eve, where they are sessions."""
    year, first = F.year(day), lambda m: F.make_date(F.year(day), F.lit(m), F.lit(1))
    thanksgiving = F.date_add(first(11), ((4 - weekday(first(11)) + 7) % 7 + 21).cast("int"))
    return (day == F.make_date(year, F.lit(7), F.lit(3))) | (day == F.date_add(thanksgiving, 1)) | (day == F.make_date(year, F.lit(12), F.lit(24)))


def sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """session, ordinal (from 0), early_close, opens_at and closes_at (UTC) of the sessions from ``first`` to ``last``.

    A calendar has some 250 rows a year, whatever the data, so it is numbered in one window.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("session"))
    years = days.select(F.year("session").alias("y")).distinct().select("y", F.explode(market_holidays(F.col("y"))).alias("session"))
    # a holiday of the next year may be kept in this one
    further = spark.range(1).select(F.explode(market_holidays(F.year(F.lit(last).cast("date")) + 1)).alias("session"))
    held = years.select("session").union(further)
    open_days = days.where(~weekday(F.col("session")).isin(0, 6)).join(F.broadcast(held), "session", "left_anti")
    numbered = open_days.withColumn("ordinal", (F.row_number().over(Window.orderBy("session")) - 1).cast("long")).withColumn("early_close", _closes_early(F.col("session")))
    minute = lambda m: F.to_utc_timestamp(F.col("session").cast("timestamp") + F.make_dt_interval(mins=m), ZONE)
    return numbered.select("session", "ordinal", "early_close", minute(F.lit(OPENS)).alias("opens_at"), minute(F.when(F.col("early_close"), CLOSES_EARLY).otherwise(CLOSES)).alias("closes_at"))


def session_of(rows: DataFrame, calendar: DataFrame, date: str, name: str = "ordinal") -> DataFrame:
    """Adds ``name``, the ordinal of the last session on or before ``date``; null before the calendar begins."""
    return rows.join(_spans(calendar, name), F.col(date) == F.col("__day"), "left").drop("__day")


def _spans(calendar: DataFrame, name: str) -> DataFrame:
    """A row for every day from the first session to the last one, with the ordinal of its session or the one before."""
    after = F.lead("session").over(Window.orderBy("session"))
    spans = calendar.withColumn("__to", F.coalesce(F.date_add(after, -1), F.col("session")))
    return F.broadcast(spans.select(F.explode(F.sequence("session", "__to")).alias("__day"), F.col("ordinal").alias(name)))


def sessions_later(rows: DataFrame, calendar: DataFrame, date: str, steps: tuple[int, ...]) -> DataFrame:
    """Each row once for every number of steps: ``sessions`` and ``target``, the session so many after that of its date.

    Rows before the calendar begins, and steps beyond its end, give no row.
    """
    placed = session_of(rows, calendar, date, "__o").withColumn("sessions", F.explode(F.array(*[F.lit(s) for s in steps])))
    ends = F.broadcast(calendar.select(F.col("ordinal").alias("__t"), F.col("session").alias("target")))
    return placed.join(ends, F.col("__o") + F.col("sessions") == F.col("__t")).drop("__o", "__t")


def sessions_between(rows: DataFrame, calendar: DataFrame, a: str, b: str, name: str = "sessions") -> DataFrame:
    """Adds ``name``, how many sessions after that of ``a`` the session of ``b`` is."""
    both = session_of(session_of(rows, calendar, a, "__a"), calendar, b, "__b")
    return both.withColumn(name, F.col("__b") - F.col("__a")).drop("__a", "__b")


def forward_session_returns(members: DataFrame, bars: DataFrame, calendar: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """(as_of, ticker, sessions, base_date, end_date, forward_return): from the close at a date's session to that so many sessions later.

    Both ends are equalities with a session's bar; a missing bar, or one without a close above 0, gives no row.
    """
    ends = sessions_later(members, calendar, "as_of", (0, *steps))
    priced = ends.join(bars.where("close > 0").select("ticker", F.col("price_date").alias("target"), "close"), ["ticker", "target"])
    base = priced.where("sessions = 0").select("as_of", "ticker", F.col("target").alias("base_date"), F.col("close").alias("base_close"))
    told = priced.where("sessions > 0").join(base, ["as_of", "ticker"])
    return told.select("as_of", "ticker", "sessions", "base_date", F.col("target").alias("end_date"), (F.col("close") / F.col("base_close") - 1).alias("forward_return"))
