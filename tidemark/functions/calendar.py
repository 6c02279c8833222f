"""Calendar arithmetic in UTC days on ``DateType`` columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_days(start: Column, end: Column) -> Column:
    """Inclusive length of a period; null without a start."""
    return F.date_diff(end, start) + 1


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b))


def is_next_day(a: Column, b: Column) -> Column:
    """Whether ``b`` is the day after ``a``."""
    return F.date_diff(b, a) == 1


def within(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether a period lies inside another, bounds included."""
    return (start >= low) & (end <= high)


def add_months_overflow(d: Column, n: int | Column) -> Column:
    """The same day number ``n`` months on; days a month lacks run over into the next one."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.dayofmonth(d) - 1)


def previous_year_date(d: Column) -> Column:
    """The same month and day a year before; null for 29 February."""
    return F.try_to_date(F.concat_ws("-", F.year(d) - 1, F.date_format(d, "MM-dd")), "yyyy-MM-dd")


def previous_period_end(d: Column, frequency: str) -> Column:
    """The last day of the last completed month, quarter or year before ``d``."""
    unit = {"month": "MM", "quarter": "quarter", "year": "year"}[frequency]
    return F.date_add(F.trunc(d, unit), -1)


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)


def weekday(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def fiscal_year_of_end(end: Column) -> Column:
    """A year that ends in the first week of January is the one before."""
    return F.when((F.month(end) == 1) & (F.dayofmonth(end) <= 7), F.year(end) - 1).otherwise(F.year(end))


def quarter_label(d: Column) -> Column:
    """``24Q3``."""
    return F.concat(F.date_format(d, "yy"), F.lit("Q"), F.quarter(d).cast("string"))


def snapshot_label(d: Column, latest: Column | None = None) -> Column:
    """``2024 Q3`` for quarter ends, ``Latest`` for the latest date, the ISO date otherwise."""
    quarter_end = (d == F.last_day(d)) & (F.month(d) % 3 == 0)
    label = F.when(quarter_end, F.concat(F.year(d).cast("string"), F.lit(" Q"), F.quarter(d).cast("string"))).otherwise(d.cast("string"))
    return label if latest is None else F.when(d == latest, F.lit("Latest")).otherwise(label)


def month_day_distance(a: Column, b: Column) -> Column:
    """Days between two dates' months and days around the year's turn."""
    there = lambda x, y: F.make_date(F.lit(y), F.month(x), F.least(F.dayofmonth(x), F.lit(28)) if y % 4 else F.dayofmonth(x))
    base = there(a, 2024)
    return F.least(*[F.abs(F.date_diff(base, F.add_months(there(b, 2024), 12 * k))) for k in (-1, 0, 1)])


def snapshot_dates(first: Column, last: Column, frequency: str = "quarter") -> Column:
    """An array of the period ends from ``first`` to ``last``, both included if they are ends."""
    months = {"month": 1, "quarter": 3, "year": 12}[frequency]
    unit = {"month": "MM", "quarter": "quarter", "year": "year"}[frequency]
    starts = F.sequence(F.trunc(first, unit), F.trunc(last, unit), F.expr(f"interval {months} month"))
    ends = F.transform(starts, lambda s: F.date_add(F.add_months(s, months), -1))
    return F.filter(ends, lambda e: (e >= first) & (e <= last))


def timeline_dates(latest: dt.date, years: int) -> list[dt.date]:
    """Quarter ends of the ``years`` completed years and the running year before ``latest``, and ``latest`` itself."""
    ends = []
    for year in range(latest.year - years, latest.year + 1):
        for month in (3, 6, 9, 12):
            following = dt.date(year + month // 12, month % 12 + 1, 1)
            ends.append(following - dt.timedelta(days=1))
    return sorted({d for d in ends if d < latest} | {latest})


def backfill_windows(start: Column, end: Column, years: int = 10) -> Column:
    """Windows (low, high) of at most ``years`` years that tile start..end from its end backwards."""
    steps = F.sequence(F.lit(0), F.floor(F.months_between(end, start) / (12 * years)).cast("int"))
    windows = F.transform(steps, lambda k: F.struct(
        F.greatest(start, F.date_add(F.add_months(end, -(k + 1) * (12 * years)), 1)).alias("low"), F.add_months(end, -k * (12 * years)).alias("high")
    ))
    return F.filter(windows, lambda w: w["low"] <= w["high"])


def easter(y: Column) -> Column:
    """Easter Sunday of a year in the Gregorian calendar, by integer arithmetic."""
    whole = lambda a, b: F.floor(a / b)
    a, b, c = y % 19, whole(y, 100), y % 100
    d = (19 * a + b - whole(b, 4) - whole(b - whole(b + 8, 25) + 1, 3) + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * whole(c, 4) - d - c % 4) % 7
    f = d + e - 7 * whole(a + 11 * d + 22 * e, 451) + 114
    return F.make_date(y, whole(f, 31).cast("int"), (f % 31 + 1).cast("int"))


def market_holidays(year: Column) -> Column:
    """The full-day holidays of the New York exchanges in a year, as an array of dates.

    A holiday on Saturday is kept on Friday (New Year's Day isn't kept then), one on Sunday on Monday.
    """

    def nth(month: int, day: int, n: int) -> Column:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, ((day - weekday(first) + 7) % 7 + 7 * (n - 1)).cast("int"))

    def kept(d: Column, drop_saturday: bool = False) -> Column:
        saturday = F.lit(None).cast("date") if drop_saturday else F.date_add(d, -1)
        return F.when(weekday(d) == 6, saturday).when(weekday(d) == 0, F.date_add(d, 1)).otherwise(d)

    fixed = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    last_may = F.date_add(fixed(5, 31), (-((weekday(fixed(5, 31)) + 6) % 7)).cast("int"))
    days = F.array(
        kept(fixed(1, 1), True), nth(1, 1, 3), nth(2, 1, 3), F.date_add(easter(year), -2), last_may,
        F.when(year >= 2022, kept(fixed(6, 19))), kept(fixed(7, 4)), nth(9, 1, 1), nth(11, 4, 4), kept(fixed(12, 25)),
    )
    return F.array_sort(F.filter(days, lambda d: d.isNotNull()))


def market_state(ts: Column) -> Column:
    """``open``, ``closed``, ``weekend`` or ``holiday`` for a UTC timestamp, by New York time (09:30 to 16:00)."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    return (
        F.when(weekday(day).isin(0, 6), F.lit("weekend"))
        .when(F.array_contains(market_holidays(F.year(day)), day), F.lit("holiday"))
        .when((minute >= 570) & (minute < 960), F.lit("open")).otherwise(F.lit("closed"))
    )
