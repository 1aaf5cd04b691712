"""Window operators W1-W6, W9-W11 as Column builders over a laid-out series.

All builders take a :class:`~orrery.plans.sequence.Series` and are meant for a
frame produced by :func:`~orrery.plans.sequence.layout` (or any frame that has
the same internal columns).  They share one window order, so Catalyst plans a
single sort for all of them.

Warm-up semantics follow the reference exactly: a rolling statistic over
``n`` rows is NULL until ``n`` non-null inputs are in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import c, safe_div
from ..plans.sequence import ORDINAL, Series


def diff(x, s: Series, k: int = 1) -> Column:
    """``x - x[k rows back]``; NULL on the first ``k`` rows."""
    return c(x) - F.lag(c(x), k).over(s.w)


def lag(x, s: Series, k: int) -> Column:
    """Value ``k`` rows back (type preserved, NULL before the start)."""
    return F.lag(c(x), k).over(s.w)


def lead(x, s: Series, k: int) -> Column:
    return F.lead(c(x), k).over(s.w)


def lead_return(x, s: Series, k: int = 30) -> Column:
    """Return over the next ``k`` rows, ``x[t+k] / x[t] - 1``."""
    return safe_div(lead(x, s, k), x) - 1


def pct_change(x, s: Series, k: int = 1) -> Column:
    """``x / x[k rows back] - 1``."""
    return safe_div(c(x), lag(x, s, k)) - 1


def full_window(x, s: Series, n: int, agg) -> Column:
    """Apply ``agg`` over the last ``n`` rows, only when all ``n`` are non-null."""
    w = s.rows(n)
    return F.when(F.count(c(x)).over(w) == n, agg(c(x)).over(w))


def rolling_mean(x, s: Series, n: int) -> Column:
    """Mean over the last ``n`` rows, full windows only."""
    return full_window(x, s, n, F.avg)


def rolling_sum(x, s: Series, n: int) -> Column:
    return full_window(x, s, n, F.sum)


def rolling_std(x, s: Series, n: int) -> Column:
    """Sample standard deviation over the last ``n`` rows, full windows only."""
    return full_window(x, s, n, F.stddev_samp)


def ordinal(s: Series) -> Column:
    """0-based position of the row in its whole series (from the layout)."""
    return F.col(ORDINAL)
