"""Numeric helpers: lenient casts, guarded ratios, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator, denominator, digits: int | None = 6) -> Column:
    """numerator / denominator, 0.0 where a side is missing or the denominator is zero, half-even rounded."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    value = F.coalesce(F.when(d > 0, n / d), F.lit(0.0))
    return value if digits is None else F.bround(value, digits)


def percent(fraction, digits: int) -> Column:
    return F.bround(_col(fraction) * 100, digits)


def safe_int(value, default: int | None = 0) -> Column:
    cast = _col(value).try_cast("bigint")
    return cast if default is None else F.coalesce(cast, F.lit(default).cast("bigint"))


def safe_number(value, default: float | None = 0.0) -> Column:
    cast = _col(value).try_cast("double")
    return cast if default is None else F.coalesce(cast, F.lit(float(default)))


def threshold(value, minimum: int, default: int | None = None) -> int | None:
    """A user-typed threshold: not a number or under the minimum gives the default."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return number if number >= minimum else default


def truthy_count(value) -> Column:
    """1 for true / 1 / yes in any spelling, else 0."""
    return F.coalesce(F.lower(_col(value).cast("string")).isin("1", "true", "yes"), F.lit(False)).cast("int")


def line_count(start, end) -> Column:
    """Lines of a closed interval, never negative."""
    return F.greatest(F.lit(0), _col(end) - _col(start) + 1)


def heat_class(count, lowest, highest) -> Column:
    """Min-max density of a count mapped to the classes 0..4."""
    spread = (_col(highest) - _col(lowest)).cast("double")
    density = F.when(spread > 0, (_col(count) - _col(lowest)) / spread).otherwise(F.lit(0.0))
    return F.least(F.lit(4), F.floor(density * 5).cast("int"))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)
