"""Exact money arithmetic, calendar keys and vector algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """DECIMAL(18,2): sums do not depend on the order in which tasks finish."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def as_double(c: Column) -> Column:
    return c.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Double division that gives NULL, not an error, for a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fewer_digits(c: Column, had: int, kept: int) -> Column:
    """``F.round(c, kept)`` of a double that is already rounded to ``had`` digits, by whole numbers: decimals take longer than a comparison of two rows."""
    number = F.rint(c * F.lit(10.0**had)).cast("long")
    half = F.signum(c).cast("long") * (10 ** (had - kept) // 2)
    parts = number + half
    return ((parts - parts % 10 ** (had - kept)) / 10 ** (had - kept)) / F.lit(10.0**kept)


def month_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def day_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def month_range(c: Column, first_day: str, months: int = 1) -> Column:
    """Half-open month range on the raw column, so the scan can skip row groups."""
    start = F.to_timestamp_ntz(F.lit(first_day))
    end = F.add_months(F.lit(first_day).cast("date"), months).cast("timestamp_ntz")
    return (c >= start) & (c < end)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector has norm 1, hence similarity 0 to everything."""
    guard_a = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    guard_b = F.when(norm(b) == 0, F.lit(1.0)).otherwise(norm(b))
    return dot(a, b) / (guard_a * guard_b)
