"""Registered queries: bar sources, windows and technical indicators.

Bars come from ``orders`` (one series per order priority, daily) and from
``events`` (one series per event type, hourly).  Outputs are rounded the same
way in Spark and in the DuckDB oracle: means of cent prices to 6 places (never
a rounding tie), standard deviations of prices to 4, exponential means to 3,
ratios and probabilities to 6.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import windows as W
from ..operators.ewma import ewma_over_gaps, with_ewma
from ..plans.sequence import Series, over_series
from ..session import scratch_path
from ..sources import bars as B
from .common import BARS_SQL, EVENT_BARS_SQL, dbl, ema_cte_sql, events_bars, full_window_sql, orders_bars, register, table

S = Series("symbol", "bar_date")
SH = Series("symbol", "bar_ts")

IND_ROUND = {
    "ma50": 6, "ma200": 6, "rsi": 6, "volatility": 6, "bb_middle": 6, "bb_upper": 4, "bb_lower": 4,
    "ema12": 3, "ema26": 3, "macd": 3, "macd_signal": 3, "macd_hist": 3, "atr": 6,
}

RANGE_START, RANGE_END = dt.date(1996, 3, 1), dt.date(1998, 8, 31)


def rnd(df: DataFrame, spec: dict, keys=("symbol", "bar_date")) -> DataFrame:
    return df.select(*keys, *[F.round(c, p).alias(c) for c, p in spec.items()])


def rnd_sql(spec: dict) -> str:
    return ", ".join(f"round({c}, {p}) AS {c}" for c, p in spec.items())


# --- S1-S5 -------------------------------------------------------------------

@register("bars_scan", f"SELECT * FROM ({BARS_SQL})")
def q_bars_scan(spark, sf):
    return orders_bars(spark, sf)


@register("bars_scan_hourly", f"SELECT * FROM ({EVENT_BARS_SQL})")
def q_bars_scan_hourly(spark, sf):
    return events_bars(spark, sf)


@register(
    "bars_date_range",
    f"SELECT * FROM ({BARS_SQL}) WHERE bar_date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'",
)
def q_bars_date_range(spark, sf):
    orders = B.orders_date_range(table(spark, sf, "orders"), RANGE_START, RANGE_END)
    return B.bars_date_range(B.bars_from_orders(orders), RANGE_START, RANGE_END)


@register(
    "missing_symbols",
    f"""SELECT DISTINCT o_orderpriority AS symbol FROM orders
        WHERE o_orderpriority NOT IN (SELECT symbol FROM ({BARS_SQL})
                                      WHERE bar_date BETWEEN DATE '1998-08-02' AND DATE '1998-08-02')""",
)
def q_missing_symbols(spark, sf):
    """Requested symbols (every order priority) without a bar on one day."""
    requested = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"))
    day = dt.date(1998, 8, 2)
    return B.missing_symbols(requested, B.bars_date_range(orders_bars(spark, sf), day, day))


# --- O3 ----------------------------------------------------------------------

@register(
    "bars_tail",
    f"""SELECT * EXCLUDE (k) FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM ({BARS_SQL}))
        WHERE k <= 5""",
)
def q_bars_tail(spark, sf):
    from ..operators.reports import bars_tail

    return bars_tail(orders_bars(spark, sf), 5)


# --- W1-W7, W9 ---------------------------------------------------------------

W_SQL = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"


@register("diff", f"SELECT symbol, bar_date, round(close - lag(close) OVER w, 6) AS close_diff FROM ({BARS_SQL}) {W_SQL}")
def q_diff(spark, sf):
    return over_series(
        orders_bars(spark, sf), lambda d, s: d.withColumn("close_diff", F.round(W.diff("close", s), 6)), S, back=8, ahead=0
    ).select("symbol", "bar_date", "close_diff")


LAGS = (1, 5, 10, 21)


@register(
    "lag_features",
    "SELECT symbol, bar_date, "
    + ", ".join(f"lag(close, {k}) OVER w AS close_lag_{k}, lag(volume, {k}) OVER w AS volume_lag_{k}" for k in LAGS)
    + f" FROM ({BARS_SQL}) {W_SQL}",
)
def q_lag_features(spark, sf):
    def build(d, s):
        cols = {}
        for k in LAGS:
            cols[f"close_lag_{k}"] = W.lag("close", s, k)
            cols[f"volume_lag_{k}"] = W.lag("volume", s, k)
        return d.withColumns(cols)

    out = over_series(orders_bars(spark, sf), build, S, back=32, ahead=0)
    return out.select("symbol", "bar_date", *[f"{p}_lag_{k}" for k in LAGS for p in ("close", "volume")])


@register(
    "lead_target",
    f"SELECT symbol, bar_date, round(lead(close, 30) OVER w / close - 1, 6) AS target_30d_return FROM ({BARS_SQL}) {W_SQL}",
)
def q_lead_target(spark, sf):
    out = over_series(
        orders_bars(spark, sf),
        lambda d, s: d.withColumn("target_30d_return", F.round(W.lead_return("close", s, 30), 6)),
        S, back=0, ahead=32,
    )
    return out.select("symbol", "bar_date", "target_30d_return")


MOMENTUM = (5, 21, 63)


@register(
    "pct_change",
    "SELECT symbol, bar_date, round(close / lag(close) OVER w - 1, 6) AS return_1d, "
    + ", ".join(f"round(close / lag(close, {k}) OVER w - 1, 6) AS momentum_{k}" for k in MOMENTUM)
    + f" FROM ({BARS_SQL}) {W_SQL}",
)
def q_pct_change(spark, sf):
    def build(d, s):
        cols = {"return_1d": F.round(W.pct_change("close", s, 1), 6)}
        cols.update({f"momentum_{k}": F.round(W.pct_change("close", s, k), 6) for k in MOMENTUM})
        return d.withColumns(cols)

    out = over_series(orders_bars(spark, sf), build, S, back=64, ahead=0)
    return out.select("symbol", "bar_date", "return_1d", *[f"momentum_{k}" for k in MOMENTUM])


MEANS = (14, 20, 50, 200)


@register(
    "rolling_mean",
    "SELECT symbol, bar_date, "
    + ", ".join(f"round({full_window_sql('avg', 'close', n)}, 6) AS close_mean_{n}" for n in MEANS)
    + f", round({full_window_sql('avg', 'volume', 20)}, 6) AS volume_mean_20"
    + f" FROM ({BARS_SQL}) {W_SQL}",
)
def q_rolling_mean(spark, sf):
    def build(d, s):
        cols = {f"close_mean_{n}": F.round(W.rolling_mean("close", s, n), 6) for n in MEANS}
        cols["volume_mean_20"] = F.round(W.rolling_mean("volume", s, 20), 6)
        return d.withColumns(cols)

    out = over_series(orders_bars(spark, sf), build, S, back=256, ahead=0)
    return out.select("symbol", "bar_date", *[f"close_mean_{n}" for n in MEANS], "volume_mean_20")


@register(
    "rolling_std",
    f"""SELECT symbol, bar_date, round({full_window_sql('stddev_samp', 'close', 20)}, 4) AS close_std_20,
               round({full_window_sql('stddev_samp', 'ret', 20)}, 6) AS return_std_20
        FROM (SELECT *, close / lag(close) OVER w - 1 AS ret FROM ({BARS_SQL}) {W_SQL}) {W_SQL}""",
)
def q_rolling_std(spark, sf):
    def build(d, s):
        d = d.withColumn("ret", W.pct_change("close", s, 1))
        return d.withColumns(
            {
                "close_std_20": F.round(W.rolling_std("close", s, 20), 4),
                "return_std_20": F.round(W.rolling_std("ret", s, 20), 6),
            }
        )

    out = over_series(orders_bars(spark, sf), build, S, back=32, ahead=0)
    return out.select("symbol", "bar_date", "close_std_20", "return_std_20")


@register(
    "ewma",
    f"""WITH RECURSIVE bars AS ({BARS_SQL}), {ema_cte_sql('bars', spans=(12, 26), signal=None)}
        SELECT n.symbol, n.bar_date, round(e.ema12, 3) AS ema12, round(e.ema26, 3) AS ema26
        FROM numbered n JOIN ema_rec e USING (symbol, rn)""",
)
def q_ewma(spark, sf):
    def build(d, s):
        d = with_ewma(d, "close", "ema12", 12, s)
        return with_ewma(d, "close", "ema26", 26, s)

    out = over_series(orders_bars(spark, sf), build, S)
    return out.select("symbol", "bar_date", F.round("ema12", 3).alias("ema12"), F.round("ema26", 3).alias("ema26"))


@register(
    "ewma_hourly",
    f"""WITH RECURSIVE bars AS ({EVENT_BARS_SQL}),
        {ema_cte_sql('bars', spans=(12, 26), signal=9, order='bar_ts')}
        SELECT n.symbol, n.bar_ts, round(e.ema12, 3) AS ema12, round(e.ema26, 3) AS ema26,
               round(e.macd_signal, 3) AS macd_signal
        FROM numbered n JOIN ema_rec e USING (symbol, rn)""",
)
def q_ewma_hourly(spark, sf):
    """W7 on the hourly event bars (timestamp order, day chunks)."""
    out = over_series(events_bars(spark, sf), lambda d, s: I.with_macd(d, s), SH, chunk_unit="day")
    return out.select(
        "symbol", "bar_ts", *[F.round(c, 3).alias(c) for c in ("ema12", "ema26", "macd_signal")]
    )


# a day without a quote: some by the day's order count, and whole stretches
NO_QUOTE = "volume % 3 = 2 OR (month(bar_date) IN (3, 4) AND year(bar_date) % 2 = 0)"


def _gap_ema_sql(span: int) -> str:
    """One step of the recursion: the mean so far, and rows since its last value."""
    a = 2.0 / (span + 1.0)
    w = f"power({dbl(1 - a)}, e.g{span} + 1)"
    mean = f"CASE WHEN n.x IS NULL THEN e.y{span} WHEN e.y{span} IS NULL THEN n.x ELSE ({w} * e.y{span} + {dbl(a)} * n.x) / ({w} + {dbl(a)}) END"
    return f"{mean}, CASE WHEN n.x IS NULL THEN e.g{span} + 1 ELSE 0 END"


@register(
    "ewma_gaps",
    f"""WITH RECURSIVE bars AS ({BARS_SQL}),
n AS (SELECT symbol, bar_date, CASE WHEN NOT ({NO_QUOTE}) THEN close END AS x,
             row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS rn FROM bars),
e(symbol, rn, y12, g12, y26, g26) AS (
  SELECT symbol, rn, x, 0, x, 0 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn, {_gap_ema_sql(12)}, {_gap_ema_sql(26)} FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1
)
SELECT symbol, bar_date, x AS quote, round(y12, 3) AS ema12, round(y26, 3) AS ema26 FROM n JOIN e USING (symbol, rn)""",
)
def q_ewma_gaps(spark, sf):
    """W7 with missing quotes, both spans on one layout."""
    bars = orders_bars(spark, sf).select("symbol", "bar_date", F.expr(f"CASE WHEN NOT ({NO_QUOTE}) THEN close END").alias("quote"))
    out = ewma_over_gaps(bars, "quote", {"ema12": 12, "ema26": 26}, S)
    return out.select("symbol", "bar_date", "quote", F.round("ema12", 3).alias("ema12"), F.round("ema26", 3).alias("ema26"))


TICKS = Series("symbol", "ts")


@register(
    "ticks_rolling",
    """SELECT event_type AS symbol, ts, event_id, row_number() OVER w - 1 AS rn, lag(value, 5) OVER w AS value_lag_5,
              CASE WHEN count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
                   THEN round(avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) END AS mean20
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def q_ticks_rolling(spark, sf):
    """W2, W5, W9 on raw ticks: all events lie in one month, so every chunk is dense and is split."""
    ticks = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    out = over_series(ticks, lambda d, s: d.withColumns({"value_lag_5": W.lag("value", s, 5), "mean20": W.rolling_mean("value", s, 20)}),
                      TICKS, back=20, ahead=0, block_rows=512, max_chunk_rows=512, keep_ordinal=True)
    return out.select("symbol", "ts", "event_id", F.col("rn").cast("bigint").alias("rn"), "value_lag_5", F.round("mean20", 6).alias("mean20"))


@register(
    "ordinal",
    f"SELECT symbol, bar_date, row_number() OVER w - 1 AS rn FROM ({BARS_SQL}) {W_SQL}",
)
def q_ordinal(spark, sf):
    # 1-row blocks of 64 rows force many blocks: the ordinal must still be series-wide
    out = over_series(orders_bars(spark, sf), lambda d, s: d, S, back=0, ahead=0, block_rows=64, keep_ordinal=True)
    return out.select("symbol", "bar_date", F.col("rn").cast("bigint").alias("rn"))


# --- T1-T12 ------------------------------------------------------------------

INDICATORS_SQL = f"""
WITH RECURSIVE bars AS ({BARS_SQL}),
d AS (
  SELECT *, close - lag(close) OVER w AS delta, close / lag(close) OVER w - 1 AS ret,
         greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
  FROM bars {W_SQL}
),
g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain,
                CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d),
i AS (
  SELECT symbol, bar_date, close, tr,
         {full_window_sql('avg', 'close', 50)} AS ma50,
         {full_window_sql('avg', 'close', 200)} AS ma200,
         {full_window_sql('avg', 'gain', 14)} AS ag,
         {full_window_sql('avg', 'loss', 14)} AS al,
         {full_window_sql('stddev_samp', 'ret', 20)} * sqrt(252) AS volatility,
         {full_window_sql('avg', 'close', 20)} AS bb_middle,
         {full_window_sql('stddev_samp', 'close', 20)} AS sd20,
         {full_window_sql('avg', 'tr', 14)} AS atr
  FROM g {W_SQL}
),
{ema_cte_sql('bars', spans=(12, 26), signal=9)},
all_ind AS (
  SELECT i.symbol, i.bar_date, i.close, ma50, ma200,
         CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN {dbl(100)} END
              ELSE {dbl(100)} - {dbl(100)} / (1 + ag / al) END AS rsi,
         volatility, bb_middle, bb_middle + sd20 * 2 AS bb_upper, bb_middle - sd20 * 2 AS bb_lower,
         e.ema12, e.ema26, e.ema12 - e.ema26 AS macd, e.macd_signal,
         (e.ema12 - e.ema26) - e.macd_signal AS macd_hist, atr, tr AS true_range
  FROM i JOIN numbered n ON n.symbol = i.symbol AND n.bar_date = i.bar_date
         JOIN ema_rec e ON e.symbol = n.symbol AND e.rn = n.rn
)"""


def _ind_query(name: str, cols: dict, spark_cols):
    sql = f"{INDICATORS_SQL} SELECT symbol, bar_date, {rnd_sql(cols)} FROM all_ind"

    @register(name, sql)
    def q(spark, sf):
        out = I.single_indicator(orders_bars(spark, sf), spark_cols, S)
        return rnd(out, cols)

    return q


_ind_query("ind_ma50", {"ma50": 6}, "ma50")
_ind_query("ind_ma200", {"ma200": 6}, "ma200")
_ind_query("ind_rsi14", {"rsi": 6}, "rsi")
_ind_query("ind_volatility20", {"volatility": 6}, "volatility")
_ind_query("ind_bollinger20", {"bb_middle": 6, "bb_upper": 4, "bb_lower": 4}, "bollinger")
_ind_query("ind_ema12_26", {"ema12": 3, "ema26": 3}, "ema")
_ind_query("ind_macd", {"macd": 3}, "macd")
_ind_query("ind_macd_signal", {"macd_signal": 3}, "macd_signal")
_ind_query("ind_macd_hist", {"macd_hist": 3}, "macd_hist")
_ind_query("ind_true_range", {"true_range": 6}, "true_range")
_ind_query("ind_atr14", {"atr": 6}, "atr")

INDICATORS_ALL_SQL = (
    f"{INDICATORS_SQL} SELECT symbol, bar_date, close, {rnd_sql(IND_ROUND)} FROM all_ind"
)


@register("indicators_all", INDICATORS_ALL_SQL)
def q_indicators_all(spark, sf):
    out = I.indicators_all(orders_bars(spark, sf), S)
    return out.select("symbol", "bar_date", "close", *[F.round(c, p).alias(c) for c, p in IND_ROUND.items()])


def flagship(spark, sf_dir: str) -> DataFrame:
    """``entry()``: all indicators over the order bars, rows with a full MA200."""
    return q_indicators_all(spark, sf_dir).filter(F.col("ma200").isNotNull())


@register(
    "require_nonempty",
    f"""SELECT symbol FROM (SELECT o_orderpriority AS symbol FROM orders UNION SELECT event_type FROM events)
        WHERE symbol NOT IN (SELECT symbol FROM ({BARS_SQL})
                             WHERE bar_date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}')""",
)
def q_require_nonempty(spark, sf):
    """The job-level guard (raises on an empty range) followed by the per-series check: requested
    symbols, event types among them, without order bars in the range."""
    bars = B.require_nonempty(B.bars_date_range(orders_bars(spark, sf), RANGE_START, RANGE_END))
    requested = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).unionByName(
        table(spark, sf, "events").select(F.col("event_type").alias("symbol")))
    return B.missing_symbols(requested, bars)


@register("bars_stream_append", BARS_SQL)
def q_bars_stream_append(spark, sf):
    """S2-S4 as a stream: order files -> partial daily bars per micro-batch ->
    the store; returns the store's merged bars."""
    from ..streaming.bars import read_ingested, start_bar_ingest

    schema = table(spark, sf, "orders").schema
    base = scratch_path(spark, f"bar-stream-{uuid.uuid4().hex}")
    q = start_bar_ingest(spark, sf.rstrip("/"), schema, f"{base}/store", f"{base}/checkpoint", file_glob="orders.parquet")
    q.awaitTermination()
    return read_ingested(spark, f"{base}/store")


@register("bars_csv_roundtrip", f"SELECT *, close AS adj_close FROM ({BARS_SQL})")
def q_bars_csv_roundtrip(spark, sf):
    """S1 from CSV: the order bars written as OHLCV files per symbol and read back with the fixed schema."""
    path = scratch_path(spark, f"bars-csv-{uuid.uuid4().hex}")
    B.write_bars_csv(orders_bars(spark, sf), path)
    return B.read_bars_csv(spark, path)


AS_OF_DAY, YEARS_BACK = "1999-06-15", 3


@register(
    "bars_default_range",
    f"""SELECT * FROM ({BARS_SQL}) WHERE bar_date BETWEEN DATE '{AS_OF_DAY}' - {365 * YEARS_BACK} AND DATE '{AS_OF_DAY}'""",
)
def q_bars_default_range(spark, sf):
    """S2's default range: so many years of 365 days before ``as_of``, pushed into the scan."""
    return B.bars_from_orders(B.orders_date_range(table(spark, sf, "orders"), *B.bars_window_for(AS_OF_DAY, YEARS_BACK)))
