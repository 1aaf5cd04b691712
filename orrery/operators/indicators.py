"""Technical indicators T1-T12 over laid-out bar series.

Column names are lower snake case: ``ma50 ma200 rsi volatility bb_middle
bb_upper bb_lower ema12 ema26 macd macd_signal macd_hist atr``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import where_negative_abs, where_positive
from ..plans.sequence import Series, over_series
from . import windows as W
from .ewma import with_ewma

INDICATOR_COLUMNS = [
    "ma50", "ma200", "rsi", "volatility", "bb_middle", "bb_upper", "bb_lower",
    "ema12", "ema26", "macd", "macd_signal", "macd_hist", "atr",
]

# Fixed values of the reference's indicator definitions.
MA_SHORT, MA_LONG = 50, 200
RSI_ROWS = 14
VOLATILITY_ROWS, TRADING_DAYS = 20, 252
BOLLINGER_ROWS, BOLLINGER_WIDTH = 20, 2
EMA_FAST, EMA_SLOW, EMA_SIGNAL = 12, 26, 9
ATR_ROWS = 14


def ma(s: Series, n: int, x: str = "close") -> Column:
    """N-row moving average of close."""
    return W.rolling_mean(x, s, n)


def rsi(s: Series, n: int = RSI_ROWS, x: str = "close") -> Column:
    """``100 - 100 / (1 + mean gain / mean loss)`` with simple n-row means.

    The first row's change is NULL but counts as a zero gain and loss, so the
    first value appears on row n.  No losses -> 100; no gains and no losses ->
    NULL (never a division).
    """
    delta = W.diff(x, s)
    gain = W.rolling_mean(where_positive(delta), s, n)
    loss = W.rolling_mean(where_negative_abs(delta), s, n)
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)
    )


def volatility(s: Series, n: int = VOLATILITY_ROWS, x: str = "close") -> Column:
    """T4: sample std of one-row returns over n rows, annualised by sqrt(252)."""
    return W.rolling_std(W.pct_change(x, s, 1), s, n) * F.lit(math.sqrt(TRADING_DAYS))


def bollinger(s: Series, n: int = BOLLINGER_ROWS, width: float = BOLLINGER_WIDTH, x: str = "close") -> dict:
    """T5: middle = n-row mean, upper/lower = middle +- width * sample std."""
    mid = W.rolling_mean(x, s, n)
    std = W.rolling_std(x, s, n)
    return {"bb_middle": mid, "bb_upper": mid + std * width, "bb_lower": mid - std * width}


def true_range(s: Series) -> Column:
    """max(high-low, |high-prev close|, |low-prev close|); row 1 is high-low
    (``greatest`` skips NULLs)."""
    prev = W.lag("close", s, 1)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def atr(s: Series, n: int = ATR_ROWS) -> Column:
    """N-row simple mean of the true range."""
    return W.rolling_mean(true_range(s), s, n)


def with_macd(df: DataFrame, s: Series, x: str = "close") -> DataFrame:
    """EMA12, EMA26, MACD = EMA12 - EMA26, signal = EMA9 of MACD, histogram."""
    df = with_ewma(df, x, "ema12", EMA_FAST, s)
    df = with_ewma(df, x, "ema26", EMA_SLOW, s)
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = with_ewma(df, "macd", "macd_signal", EMA_SIGNAL, s)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def add_indicators(laid: DataFrame, s: Series) -> DataFrame:
    """All 13 indicator columns on a laid-out frame (one sort shared by all)."""
    df = laid.withColumns(
        {
            "ma50": ma(s, MA_SHORT),
            "ma200": ma(s, MA_LONG),
            "rsi": rsi(s),
            "volatility": volatility(s),
            **bollinger(s),
            "atr": atr(s),
        }
    )
    return with_macd(df, s)


def indicators_all(bars: DataFrame, series: Series = Series(), **layout_opts) -> DataFrame:
    """Bars + 13 indicator columns, one shuffle for the whole set."""
    cols = bars.columns
    out = over_series(bars, add_indicators, series, back=1024, ahead=0, **layout_opts)
    return out.select(*cols, *INDICATOR_COLUMNS)


def single_indicator(bars: DataFrame, name: str, series: Series = Series(), **layout_opts) -> DataFrame:
    """One indicator column (T1-T11) on its own; same layout, fewer windows."""
    def build(laid: DataFrame, s: Series) -> DataFrame:
        if name == "ma50":
            return laid.withColumn(name, ma(s, MA_SHORT))
        if name == "ma200":
            return laid.withColumn(name, ma(s, MA_LONG))
        if name == "rsi":
            return laid.withColumn(name, rsi(s))
        if name == "volatility":
            return laid.withColumn(name, volatility(s))
        if name == "bollinger":
            return laid.withColumns(bollinger(s))
        if name == "true_range":
            return laid.withColumn(name, true_range(s))
        if name == "atr":
            return laid.withColumn(name, atr(s))
        if name in ("ema", "macd", "macd_signal", "macd_hist"):
            return with_macd(laid, s)
        raise ValueError(name)

    return over_series(bars, build, series, back=1024, ahead=0, **layout_opts)
