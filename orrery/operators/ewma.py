"""Recursive exponential mean ``y0 = x0, yt = a*xt + (1-a)*y(t-1)``.

Spark has no recursive window function, so the recursion is solved as a
two-level block scan with ordinary window aggregates (JVM side, no Python):

* inside a sub-block of ``S = 32`` rows, position ``q``::

      y = d^(q+1) * c_j  +  a * d^q * sum_{i<=q} x_i * d^(-i)        (d = 1 - a)

  where ``c_j`` is the value carried in from the previous sub-block — the
  sum is a running window sum over the sub-block;
* the carries follow ``c_(j+1) = d^S * c_j + B_j`` with ``B_j`` the sub-block's
  zero-carry mean at its last row, so
  ``c_j = (d^S)^j * x0 + sum_k (d^S)^(j-1-k) * B_k``; terms with
  ``(d^S)^(j-1-k)`` below 1e-30 are dropped, which leaves a short RANGE frame
  of ``M`` sub-blocks (about 14 for span 12, 29 for span 26).

The scan is seeded at the first row of each laid-out block; with a halo of
1024 rows the seed's influence on the block's own rows is below
``(1-a)^1024`` (under 1e-34 for spans up to 26), so results equal the
series-wide recursion to double precision.  ``with_ewma`` is for values without
nulls and fails on one; ``ewma_over_gaps`` takes series with missing values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sequence import BLOCK, OWN, POS, SUB, SUB_ROWS, Series, layout, unlayout


def carry_span(alpha: float, sub_rows: int = SUB_ROWS, tol_exp: int = 30) -> int:
    """Number of previous sub-blocks that still matter at ``10^-tol_exp``."""
    a = (1.0 - alpha) ** sub_rows
    if a <= 0.0:
        return 1
    return int(math.ceil(tol_exp * math.log(10.0) / -math.log(a))) + 1


def _dbl(v: float) -> str:
    """A DOUBLE literal in Spark SQL text (exact: ``repr`` round-trips)."""
    return f"{float(v)!r}D"


def with_ewma(df: DataFrame, x: str, out: str, span: float, s: Series = Series(), *,
              alpha: float | None = None, back: int = 1024) -> DataFrame:
    """Add ``out`` = exponential mean of column ``x`` (``adjust=False`` form).  A null in ``x`` is an error.

    ``back`` is the layout's halo; a span whose seed still matters after so many rows is refused.

    The expressions are written as SQL text: one call to the JVM per column
    instead of one per node of the expression tree (the builder is on the
    driver's path of every query that uses it).
    """
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    d = 1.0 - a
    if d ** back > 1e-16:
        raise ValueError(f"span {span} needs a halo of {math.ceil(-16 * math.log(10) / math.log(d))} rows, not {back}")
    S = SUB_ROWS
    big = d ** S
    m = carry_span(a)
    A, D, BIG = _dbl(a), _dbl(d), _dbl(big)
    key, blk, sub, pos = (f"`{c}`" for c in (s.key, BLOCK, SUB, POS))
    q = f"({pos} - {sub} * {S})"
    xv = f"(CASE WHEN `{x}` IS NULL THEN raise_error('null in {x}: use ewma_over_gaps') ELSE `{x}` END)"
    tmp = f"__{out}"
    in_sub = f"PARTITION BY {key}, {blk}, {sub} ORDER BY {pos}"
    df = df.withColumns(
        {
            f"{tmp}_local": F.expr(
                f"{A} * pow({D}, {q}) * sum({xv} * pow({D}, -{q})) "
                f"OVER ({in_sub} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            ),
            f"{tmp}_bfull": F.expr(
                f"{A} * sum({xv} * pow({D}, {S - 1} - {q})) "
                f"OVER ({in_sub} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            ),
            f"{tmp}_x0": F.expr(f"max(CASE WHEN {pos} = 0 THEN {xv} END) OVER (PARTITION BY {key}, {blk})"),
        }
    )
    # carry into each sub-block from the previous m sub-blocks' totals, folded
    # on the sub-block's first row only (the fold is an interpreted lambda)
    carries = (
        f"collect_list(CASE WHEN {q} = {S - 1} THEN named_struct('k', {sub}, 'b', `{tmp}_bfull`) END) "
        f"OVER (PARTITION BY {key}, {blk} ORDER BY {sub} RANGE BETWEEN {m} PRECEDING AND 1 PRECEDING)"
    )
    carry = f"aggregate({carries}, `{tmp}_x0` * pow({BIG}, {sub}), (acc, e) -> acc + e.b * pow({BIG}, {sub} - 1 - e.k))"
    df = df.withColumn(f"{tmp}_c", F.expr(f"CASE WHEN {q} = 0 THEN {carry} END"))
    # ... and spread over the sub-block with a max
    df = df.withColumn(f"{tmp}_c", F.expr(
        f"max(`{tmp}_c`) OVER ({in_sub} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
    df = df.withColumn(out, F.expr(f"pow({D}, {q} + 1) * `{tmp}_c` + `{tmp}_local`"))
    return df.drop(f"{tmp}_local", f"{tmp}_bfull", f"{tmp}_x0", f"{tmp}_c")


def slowest_decay(alpha: float) -> float:
    """The least share per row by which an old value can fade, whatever rows are null.

    After ``g`` rows the old value keeps ``d^g / (d^g + alpha)``; the rate per row is largest for some
    ``g`` of the order of ``1 / alpha``, beyond which the power takes over."""
    d = 1.0 - alpha
    rates = ((d ** g / (d ** g + alpha)) ** (1.0 / g) for g in range(1, int(20 / alpha) + 2))
    return max(rates)


def ewma_over_gaps(df: DataFrame, x: str, spans: Mapping[str, float], series: Series = Series(), *, block_rows: int = 1 << 16,
                   chunk_unit: str = "month", max_chunk_rows: int | None = None) -> DataFrame:
    """W7 over series with nulls in ``x``: ``adjust=False``, weights counted in rows; one column for each
    name of ``spans``, all from one layout.

    With ``g`` rows since the last value, a value enters as ``(d^g * y + alpha * x) / (d^g + alpha)``;
    a row without a value repeats the mean so far, and rows before the first value have none.

    Each row is an affine step ``y -> a * y + b``.  Steps are composed row by row inside sub-blocks of
    32 rows, then over the sub-blocks that still matter at 1e-30 (by the slowest possible decay), inside blocks
    whose halo is long enough for a weight to fall below 1e-16.  A value after more rows than that starts anew,
    which is its limit; rows without a value at a block's start repeat the last block's mean, found on
    a table of one row per block.
    """
    rates = {out: slowest_decay(2.0 / (span + 1.0)) for out, span in spans.items()}
    back = max(math.ceil(16 * math.log(10) / -math.log(rate)) for rate in rates.values())
    laid = layout(df, series, back=back, ahead=0, block_rows=block_rows, chunk_unit=chunk_unit, max_chunk_rows=max_chunk_rows)
    key, blk, sub, pos = (f"`{c}`" for c in (series.key, BLOCK, SUB, POS))
    in_block, in_sub = f"PARTITION BY {key}, {blk} ORDER BY {sub}, {pos}", f"PARTITION BY {key}, {blk}, {sub} ORDER BY {pos}"
    so_far, last = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", SUB_ROWS - 1
    laid = laid.withColumn("__gap", F.expr(
        f"{pos} - max(CASE WHEN `{x}` IS NOT NULL THEN {pos} END) OVER ({in_block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    for out, span in spans.items():
        a = 2.0 / (span + 1.0)
        m = math.ceil(30 * math.log(10) / -math.log(rates[out]) / SUB_ROWS) + 1
        laid = laid.withColumn("__w", F.expr(f"pow({_dbl(1.0 - a)}, __gap)"))
        laid = laid.withColumn("__a", F.expr(f"CASE WHEN `{x}` IS NULL THEN 1D WHEN __gap IS NULL THEN 0D ELSE __w / (__w + {_dbl(a)}) END"))
        laid = laid.withColumn("__b", F.expr(f"CASE WHEN `{x}` IS NULL THEN 0D ELSE (1 - __a) * `{x}` END"))
        laid = laid.withColumn("__step", F.expr(
            f"aggregate(collect_list(named_struct('a', __a, 'b', __b)) OVER ({in_sub} {so_far}), "
            "named_struct('a', 1D, 'b', 0D), (s, e) -> named_struct('a', s.a * e.a, 'b', s.b * e.a + e.b))"))
        carries = (f"array_sort(collect_list(CASE WHEN {pos} % {SUB_ROWS} = {last} THEN named_struct('k', {sub}, 'a', __step.a, 'b', __step.b) END) "
                   f"OVER (PARTITION BY {key}, {blk} ORDER BY {sub} RANGE BETWEEN {m} PRECEDING AND 1 PRECEDING))")
        laid = laid.withColumn("__c", F.expr(f"CASE WHEN {pos} % {SUB_ROWS} = 0 THEN aggregate({carries}, 0D, (y, e) -> e.a * y + e.b) END"))
        laid = laid.withColumn("__c", F.expr(f"max(__c) OVER ({in_sub} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
        laid = laid.withColumn("__y", F.expr(f"CASE WHEN `{x}` IS NOT NULL AND {OWN} THEN __step.a * __c + __step.b END"))
        # a row without a value repeats the mean of the block's last value, or else that of the last block which
        # has one: unlike a weight, a repeated mean does not fade over rows
        laid = laid.withColumn(out, F.expr(f"last(__y, true) OVER ({in_block} {so_far})")).drop("__w", "__a", "__b", "__step", "__c", "__y")
    ends = F.struct(*[F.col(out).alias(out) for out in spans])
    blocks = laid.drop("__gap").where(F.col(OWN)).groupBy(series.key, BLOCK).agg(
        F.max_by(ends, F.when(F.coalesce(*spans).isNotNull(), F.col(POS))).alias("_end"))
    held = F.last("_end", True).over(Window.partitionBy(series.key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col(series.key).alias("_ekey"), F.col(BLOCK).alias("_eblk"), held.alias("_held"))
    filled = laid.drop("__gap").join(blocks, F.col(series.key).eqNullSafe(F.col("_ekey")) & (F.col(BLOCK) == F.col("_eblk")), "left")
    filled = filled.withColumns({out: F.coalesce(out, F.col("_held").getField(out)) for out in spans})
    return unlayout(filled.drop("_ekey", "_eblk", "_held"), keep_ordinal=False)
