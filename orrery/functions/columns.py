"""Scalar Column helpers shared by operators (P8-P10, safe arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """``num / den`` with NULL instead of an error (ANSI) or inf on a zero divisor."""
    return F.try_divide(c(num), F.when(c(den) != 0, c(den)))


def where_positive(x) -> Column:
    """Keep ``x`` where ``x > 0``, else 0 (NULL also becomes 0)."""
    return F.when(c(x) > 0, c(x)).otherwise(F.lit(0.0))


def where_negative_abs(x) -> Column:
    """P9 (loss side): ``-x`` where ``x < 0``, else 0."""
    return F.when(c(x) < 0, -c(x)).otherwise(F.lit(0.0))


def positive_support(x, value) -> Column:
    """P10: ``value`` where ``x > 0``, else 0."""
    return F.when(c(x) > 0, c(value)).otherwise(F.lit(0.0))


def with_default(x, default) -> Column:
    """Default for a missing value."""
    return F.coalesce(c(x), F.lit(default) if not isinstance(default, Column) else default)


def rounded(x, places: int) -> Column:
    return F.round(c(x), places)
