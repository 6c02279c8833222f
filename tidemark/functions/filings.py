"""Labels on filing facts: forms, fiscal periods, frames, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticker(x: Column) -> Column:
    return F.upper(F.trim(x))


def is_ticker_like(x: Column) -> Column:
    return x.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$")


def share_class_ticker(symbol: Column, name: Column) -> Column:
    """``XYZB`` of a company whose name says CLASS B becomes ``XYZ-B``; null where nothing needs repair."""
    letter = F.regexp_extract(F.upper(name), r"\b(?:CLASS|CL)\s+([A-Z])\b", 1)
    bare = ticker(symbol)
    fits = (letter != "") & bare.rlike(r"^[A-Z]{2,5}$") & (F.right(bare, F.lit(1)) == letter)
    return F.when(fits, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit("-"), letter))


def padded_cik(x: Column) -> Column:
    return F.lpad(F.regexp_replace(x.cast("string"), r"\D", ""), 10, "0")


def form_hint(form: Column) -> Column:
    """annual, quarter, current or unknown; amendments count as their form."""
    base = F.regexp_replace(F.upper(F.trim(form)), "/A$", "")
    return (
        F.when(base.isin("10-K", "20-F", "40-F"), F.lit("annual"))
        .when(base == "10-Q", F.lit("quarter")).when(base.isin("8-K", "6-K"), F.lit("current")).otherwise(F.lit("unknown"))
    )


def period_hint(fp: Column) -> Column:
    """annual for FY, quarter for Q1 to Q4, unknown otherwise."""
    label = F.upper(F.trim(fp))
    return F.when(label == "FY", F.lit("annual")).when(label.rlike("^Q[1-4]$"), F.lit("quarter")).otherwise(F.lit("unknown"))


def period_quarter(fp: Column) -> Column:
    """1 to 4 for Q1 to Q4, null otherwise."""
    label = F.upper(F.trim(fp))
    return F.when(label.rlike("^Q[1-4]$"), F.substring(label, 2, 1).cast("int"))


def frame_parts(frame: Column) -> Column:
    """struct(year, quarter, instant) of ``CY2020``, ``CY2020Q1`` or ``CY2020Q1I``; null for anything else."""
    pattern = r"^CY(\d{4})(?:Q([1-4])(I)?)?$"
    part = lambda i: F.regexp_extract(frame, pattern, i)
    return F.when(frame.rlike(pattern), F.struct(
        part(1).try_cast("int").alias("year"), F.nullif(part(2), F.lit("")).try_cast("int").alias("quarter"), (part(3) == "I").alias("instant")
    ))


def duration_class(days: Column) -> Column:
    """annual, quarter, ytd, instant or other, tried in that order; a null duration is an instant."""
    return (
        F.when(days.isNull() | (days == 0), F.lit("instant"))
        .when(days.between(330, 400), F.lit("annual")).when(days.between(75, 120), F.lit("quarter"))
        .when(days.between(130, 300), F.lit("ytd")).otherwise(F.lit("other"))
    )


def fiscal_year(fy: Column) -> Column:
    """A year of four digits as an integer, null for anything else."""
    year = fy.cast("string").try_cast("int")
    return F.when(year.between(1000, 9999), year)
