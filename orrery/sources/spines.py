"""Generated spines (S8-S10): calendar days, integer years, linspace grids.

Spines are generated next to the rows that need them (``sequence`` +
``explode`` per key), so they grow with the number of keys and need no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c


def calendar_spine(last: DataFrame, days: int, date_col: str = "bar_date", step_col: str = "step") -> DataFrame:
    """``days`` consecutive calendar days after each key's last date.

    ``last`` has one row per key; output adds ``step`` (0-based) and
    ``forecast_date`` = last date + 1 + step.
    """
    return last.select(
        "*", F.posexplode(F.sequence(F.date_add(c(date_col), 1), F.date_add(c(date_col), days))).alias(step_col, "forecast_date")
    )


def year_spine(df: DataFrame, start, stop, step: int = 1, out: str = "year") -> DataFrame:
    """Half-open integer range ``[start, stop)`` with ``step`` per row of ``df``
    (``start``/``stop`` may be columns, e.g. ``base_year`` and ``base_year + 40``)."""
    s, e = c(start) if not isinstance(start, int) else F.lit(start), c(stop) if not isinstance(stop, int) else F.lit(stop)
    return df.select("*", F.explode(F.sequence(s.cast("int"), (e - 1).cast("int"), F.lit(step))).alias(out))


def linspace_grid(df: DataFrame, start: str, span_years: int = 40, num: int = 1000, out: str = "x") -> DataFrame:
    """``num`` points over ``[start, start + span]`` inclusive per row of ``df``;
    adds ``i`` (0-based) and ``x``."""
    step = span_years / (num - 1)
    g = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("i"))
    return g.withColumn(
        out,
        F.when(F.col("i") == num - 1, (c(start) + F.lit(span_years)).cast("double")).otherwise(
            F.col("i") * F.lit(step) + c(start)
        ),
    )
