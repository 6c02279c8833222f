"""Null-aware arithmetic: a missing or impossible result is null, never NaN or infinity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` as a double, null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def growth(current: Column, base: Column) -> Column:
    """(current - base) / |base|; null when the base is 0 or either side is missing."""
    return F.when(base != 0, (current - base) / F.abs(base))


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient where the denominator is above 0, as valuation multiples need it."""
    return F.when(denominator > 0, numerator / denominator)


def ratio_to_size(numerator: Column, denominator: Column) -> Column:
    """The quotient by the denominator's absolute value; only 0 is refused."""
    return F.when(denominator != 0, numerator / F.abs(denominator))


def deviation(value: Column, reference: Column) -> Column:
    """value / reference - 1, signed; null when the reference is 0."""
    return F.when(reference != 0, value / reference - 1)


def cagr(last: Column, first: Column, years: Column) -> Column:
    """Compound growth a year; both ends and the number of years have to be positive."""
    return F.when((last > 0) & (first > 0) & (years > 0), F.pow(last / first, 1 / years) - 1)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def mean_of(values: Sequence[Column]) -> Column:
    """The mean of those that aren't null; null if all are."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(known) > 0, total / F.size(known))


def max_of(values: Sequence[Column]) -> Column:
    """The largest that isn't null."""
    return F.greatest(*values) if len(values) > 1 else values[0]


def sum_nullable(a: Column, b: Column) -> Column:
    """Null only if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def as_number(x: Column, kind: str) -> Column:
    """A feature source as a double: booleans count 1 and 0."""
    return x.cast("int").cast("double") if kind == "boolean" else x.cast("double")


def robust_z(x: Column, centre: Column, scale: Column, clip: float = 3.0) -> Column:
    """(x - centre) / scale within ±clip; missing values and a scale of 0 give 0."""
    z = F.when(scale > 0, (x - centre) / scale)
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).otherwise(0.0)


def normalized_entropy(counts: Column) -> Column:
    """-sum(p ln p) / ln k over an array of counts; null for fewer than two positive ones."""
    some = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(some, F.lit(0.0), lambda a, c: a + c)
    spread = F.aggregate(some, F.lit(0.0), lambda a, c: a - (c / total) * F.log(c / total))
    return F.when(F.size(some) > 1, spread / F.log(F.size(some).cast("double")))
