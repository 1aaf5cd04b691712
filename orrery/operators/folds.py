"""Expanding-window folds per series, and their moments in one pass.

With ``k`` folds a series of ``n`` rows has ``k`` test stretches of ``n div (k + 1)`` rows at its end, one after
the other; a fold trains on all rows before its stretch but the last ``embargo`` ones (a target that looks ahead
would leak).  All folds' borders cut a series into at most 2k + 1 cells.  Count, sum and sum of squares
per cell are one partially aggregated pass over the rows; a fold's training moments are the sum of
the cells before its border, so rows are never copied per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sequence import LENGTH, ORDINAL, Series, over_series

FOLDS = 5


def numbered(rows: DataFrame, series: Series = Series(), **layout_opts) -> DataFrame:
    """Rows with their ordinal ``rn`` in the series and the series' length ``n``."""
    laid = over_series(rows, lambda d, s: d, series, back=0, ahead=0, keep_ordinal=True, keep_length=True, **layout_opts)
    return laid.withColumnRenamed(LENGTH, "n")


def test_start(fold: Column, k: int) -> Column:
    """The first ordinal of a fold's test stretch (folds 1 to k)."""
    size = F.expr(f"n div {k + 1}")
    return F.col("n") - (F.lit(k + 1) - fold) * size


def fold_rows(rows: DataFrame, fold: int, k: int = FOLDS, embargo: int = 0) -> DataFrame:
    """Training and test rows of one fold of ``numbered`` rows, with ``is_test``."""
    first = test_start(F.lit(fold), k)
    size = F.expr(f"n div {k + 1}")
    test = (F.col(ORDINAL) >= first) & (F.col(ORDINAL) < first + size)
    return rows.withColumn("is_test", test).where(test | (F.col(ORDINAL) < first - embargo))


def fold_cells(rows: DataFrame, value: str, k: int = FOLDS, embargo: int = 0, series: Series = Series()) -> DataFrame:
    """``(symbol, n, cell, first, last, count, total, squares)`` of ``numbered`` rows."""
    borders = [b for f in range(1, k + 1) for b in (test_start(F.lit(f), k), test_start(F.lit(f), k) - embargo)]
    cell = sum(((F.col(ORDINAL) >= b).cast("int") for b in borders), F.lit(0))
    v = F.col(value)
    return rows.groupBy(series.key, "n", cell.alias("cell")).agg(
        F.min(ORDINAL).alias("first"), F.max(ORDINAL).alias("last"), F.count(v).alias("count"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def mean_fold_scores(rows: DataFrame, value: str, k: int = FOLDS, embargo: int = 0, series: Series = Series()) -> DataFrame:
    """``(symbol, fold, n_train, n_test, mean_train, r2)``: per fold the score of the training mean on the test
    rows, all from the cells.  Folds without training or test rows are left out; a constant test stretch has no score."""
    cells = fold_cells(rows, value, k, embargo, series)
    each = cells.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    size = F.expr(f"n div {k + 1}")
    first = test_start(F.col("fold"), k)
    train, test = F.col("last") < first - embargo, (F.col("first") >= first) & (F.col("last") < first + size)
    part = lambda where, c: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    m = each.groupBy(series.key, "fold").agg(
        part(train, "count").alias("n_train"), part(train, "total").alias("_s"),
        part(test, "count").alias("n_test"), part(test, "total").alias("_t"), part(test, "squares").alias("_q")).where("n_train > 0 AND n_test > 0")
    m = m.withColumn("mean_train", F.col("_s") / F.col("n_train"))
    res = F.col("_q") - 2 * F.col("mean_train") * F.col("_t") + F.col("n_test") * F.col("mean_train") * F.col("mean_train")
    dev = F.col("_q") - F.col("_t") * F.col("_t") / F.col("n_test")
    return m.select(series.key, "fold", "n_train", "n_test", "mean_train", F.when(dev > 0, 1 - res / dev).alias("r2"))
