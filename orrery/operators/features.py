"""Feature sets (F1, F2), projections/filters (P1-P4, P7, P8) and chronological
splits (W10, W11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sequence import BLOCK, ORDINAL, OWN, Series, layout, over_series
from . import indicators as I
from . import windows as W

BASE_COLUMNS = ["open", "high", "low", "close", "volume", "ma50", "ma200", "rsi", "volatility"]
LAG_PERIODS = (1, 5, 10, 21)
MOMENTUM_PERIODS = (5, 21, 63)
TARGET = "target_30d_return"
TARGET_ROWS = 30

def feature_columns(extended: bool = False, constants: bool = True) -> list[str]:
    """Feature names in model input order."""
    if not extended:
        cols = list(BASE_COLUMNS)
        for k in LAG_PERIODS:
            cols += [f"close_lag_{k}", f"volume_lag_{k}"]
        cols += [f"momentum_{k}" for k in MOMENTUM_PERIODS]
        if constants:
            cols += ["ai_sentiment", "agi_probability"]
        return cols
    cols = ["open", "high", "low", "close", "volume", *I.INDICATOR_COLUMNS]
    for k in LAG_PERIODS:
        cols += [f"close_lag_{k}", f"volume_lag_{k}", f"rsi_lag_{k}"]
    cols += [f"momentum_{k}" for k in MOMENTUM_PERIODS]
    cols += ["day_of_week", "month", "return_1d"]
    return cols


def _base_build(laid: DataFrame, s: Series, extended: bool) -> DataFrame:
    if extended:
        df = I.add_indicators(laid, s)
    else:
        df = laid.withColumns(
            {"ma50": I.ma(s, I.MA_SHORT), "ma200": I.ma(s, I.MA_LONG), "rsi": I.rsi(s), "volatility": I.volatility(s)}
        )
    cols = {}
    for k in LAG_PERIODS:
        cols[f"close_lag_{k}"] = W.lag("close", s, k)
        cols[f"volume_lag_{k}"] = W.lag("volume", s, k)
        if extended:
            cols[f"rsi_lag_{k}"] = W.lag("rsi", s, k)
    for k in MOMENTUM_PERIODS:
        cols[f"momentum_{k}"] = W.pct_change("close", s, k)
    if extended:
        cols["day_of_week"] = F.weekday(s.order)
        cols["month"] = F.month(s.order)
        cols["return_1d"] = W.pct_change("close", s, 1)
    cols[TARGET] = W.lead_return("close", s, TARGET_ROWS)
    return df.withColumns(cols)


def raw_features(bars: DataFrame, series: Series = Series(), extended: bool = False, **layout_opts) -> DataFrame:
    """All feature columns and the target, before dropping nulls (one layout).

    The last rows keep a NULL target; the latest one is what a forecast
    predicts from (the reference read the indicator row instead, which lacks
    the lag and momentum columns)."""
    back = 1024 if extended else 256
    out = over_series(bars, lambda d, s: _base_build(d, s, extended), series, back=back, ahead=32, **layout_opts)
    keys = [series.key, series.order]
    return out.select(*keys, *feature_columns(extended, constants=False), TARGET)


def with_constants(df: DataFrame, landscape: DataFrame) -> DataFrame:
    """The landscape scalars (``ai_sentiment``, ``agi_probability``) of every
    scenario a series is exposed to, so a row per (row, scenario).

    ``landscape`` holds one row per (symbol, scenario_id); the equi join leaves
    its size to AQE and a hot symbol to the skew join."""
    return df.join(landscape.select("symbol", "scenario_id", "ai_sentiment", "agi_probability"), "symbol")


def features_pipeline(bars: DataFrame, landscape: DataFrame | None = None, series: Series = Series(),
                      **layout_opts) -> DataFrame:
    """9 base columns, close/volume lags, momentum, two constants and the
    30-row target; rows with any NULL dropped (P4)."""
    f = raw_features(bars, series, extended=False, **layout_opts)
    if landscape is not None:
        f = with_constants(f, landscape)
    return f.dropna("any")


def features_extended(bars: DataFrame, series: Series = Series(), **layout_opts) -> DataFrame:
    """all indicators, close/volume/RSI lags, momentum, weekday (Monday = 0),
    month, one-row return and the target; rows with any NULL dropped."""
    return raw_features(bars, series, extended=True, **layout_opts).dropna("any")


def features_with_split(bars: DataFrame, series: Series = Series(), test_size: float = 0.2, rule: str = "ceil", embargo: int = 0,
                        extended: bool = False, **layout_opts) -> DataFrame:
    """F1 (without constants) or F2 with W10 / W11's ``is_test``, on the features' own layout.

    Rows that keep all features are counted inside each block, in order, by one more window; one row per
    block then gives every block its offset and every series its length.  So the split needs neither a
    second layout nor a written copy of the features, and no job runs while it is built."""
    laid = layout(bars, series, back=1024 if extended else 256, ahead=32, **layout_opts)
    cols = [series.key, series.order, *feature_columns(extended, constants=False), TARGET]
    built = _base_build(laid, series, extended)
    floats = {f.name for f in built.schema if f.dataType.simpleString() in ("double", "float")}
    whole = " AND ".join(f"`{c}` IS NOT NULL" + (f" AND NOT isnan(`{c}`)" if c in floats else "") for c in cols)  # as dropna("any")
    built = built.withColumn("_kept", F.expr(f"CAST({OWN} AND {whole} AS INT)"))
    built = built.withColumn("_nth", F.sum("_kept").over(series.w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = built.where("_kept = 1").select(*cols, BLOCK, "_nth")
    blocks = rows.groupBy(series.key, BLOCK).agg(F.max("_nth").alias("_rows"))
    w = Window.partitionBy(series.key)
    before = F.sum("_rows").over(w.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    blocks = blocks.select(F.col(series.key).alias("_bkey"), F.col(BLOCK).alias("_bblk"), before.alias("_before"), F.sum("_rows").over(w).alias("_n"))
    out = rows.join(blocks, F.col(series.key).eqNullSafe(F.col("_bkey")) & (F.col(BLOCK) == F.col("_bblk")))
    out = out.withColumn(ORDINAL, F.col("_before") + F.col("_nth") - 1)
    return _split(out, test_size, rule, embargo).select(*cols, "is_test")


def _split(rows: DataFrame, test_size: float, rule: str, embargo: int) -> DataFrame:
    """``is_test`` from the ordinal and the length ``_n`` of each row's series."""
    if rule == "ceil":
        n_train = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size))
    elif rule == "floor":
        n_train = F.floor(F.col("_n") * F.lit(1.0 - test_size))
    else:
        raise ValueError(rule)
    out = rows.withColumn("is_test", F.col(ORDINAL) >= n_train)
    return out.where(F.col("is_test") | (F.col(ORDINAL) < n_train - embargo)) if embargo else out


def project_columns(df: DataFrame, keys=("symbol", "bar_date")) -> DataFrame:
    """Keys + the nine base feature columns."""
    return df.select(*keys, *BASE_COLUMNS)


def drop_target(df: DataFrame) -> DataFrame:
    """The feature matrix without the target column."""
    return df.drop(TARGET)


def with_split(features: DataFrame, series: Series = Series(), test_size: float = 0.2, rule: str = "ceil",
               embargo: int = 0, cut_lineage: bool = True) -> DataFrame:
    """Chronological split per series, no shuffling of rows.

    ``ceil``: the last ``ceil(n * test_size)`` rows are test (hold-out split);
    ``floor``: the first ``floor(n * (1 - test_size))`` rows are train.  The
    products are float products, as in the reference.
    ``embargo`` drops that many train rows before the first test row (the
    target looks 30 rows ahead).  Ordinals and series lengths come from the
    block layout, so no window holds a whole series.  The layout reads its
    input twice (rows and chunk counts); with ``cut_lineage`` the feature table
    is first written as a reliable checkpoint in the shared checkpoint folder
    so its window chain is not computed twice.
    """
    if cut_lineage:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(features.sparkSession)
        features = features.checkpoint(eager=True)
    out = over_series(features, lambda d, s: d, series, back=0, ahead=0, keep_ordinal=True, keep_length=True)
    out = _split(out, test_size, rule, embargo)
    return out.drop("_n", ORDINAL)
