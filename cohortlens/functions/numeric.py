"""Exact percentages and means.

Counts and sums stay exact decimals until they are rounded, so 49 of 400 is 12.3 on every engine
that rounds exact numerics half away from zero. Results are doubles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 · part / whole, NULL where ``whole`` is zero or NULL."""
    return F.round(F.lit(Decimal("100.0")) * part / F.nullif(whole, F.lit(0)), digits).cast("double")


def exact_mean(total: Column, count: Column, scale: int = 0, digits: int = 20) -> Column:
    """total / count as a decimal of 38 digits, NULL for no rows.

    ``total`` has ``scale`` decimals and up to ``digits`` digits before them; 20 leave 18 decimals to the
    mean, 28 leave 10.
    """
    return total.cast(f"decimal({digits + scale},{scale})") / F.nullif(count, F.lit(0))


def mean_of(column: Column, scale: int = 0, digits: int = 20) -> Column:
    """Aggregate: exact mean of the non-NULL values of an integer or decimal column."""
    return exact_mean(F.sum(column), F.count(column), scale, digits)


def rounded(column: Column, digits: int) -> Column:
    """Half away from zero, as double."""
    return F.round(column, digits).cast("double")


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Quotient of two unrounded means, NULL where the denominator is zero or NULL."""
    left, right = (c.cast("decimal(28,14)") for c in (numerator, denominator))
    return rounded(left / F.nullif(right, F.lit(0).cast("decimal(28,14)")), digits)
