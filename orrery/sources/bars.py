"""Bar sources (S1-S5): readers, derived bars, store round trip, cache manifest.

A bar table is ``(symbol string, bar_date date, open, high, low, close double,
volume long)``; order is always explicit (``symbol``, ``bar_date``), never an
implicit index.  Hourly bars use ``bar_ts timestamp`` as the order column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ["symbol", "bar_date", "open", "high", "low", "close", "volume"]

BARS_CSV_SCHEMA = T.StructType(
    [
        T.StructField("bar_date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """OHLCV CSV with a header row and the date in the first column; ``adj_close`` is kept.

    The schema is fixed (no inference).  ``symbol`` comes from the argument (one file per ticker)
    or, without one, from ``symbol=<ticker>`` folders.
    """
    schema = BARS_CSV_SCHEMA if symbol is not None else T.StructType([*BARS_CSV_SCHEMA, T.StructField("symbol", T.StringType())])
    df = spark.read.csv(path, header=True, schema=schema, dateFormat="yyyy-MM-dd", enforceSchema=True)
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    return df.select(*BAR_COLUMNS, "adj_close")


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """OHLCV CSV with a header row in ``symbol=<ticker>`` folders; ``adj_close`` is the close, as in
    the sample, unless the bars carry one."""
    adj = F.col("adj_close") if "adj_close" in bars.columns else F.col("close")
    out = bars.select("symbol", "bar_date", "open", "high", "low", "close", adj.alias("adj_close"), "volume")
    by_symbol(out).write.option("header", True).partitionBy("symbol").csv(path)


def by_symbol(bars: DataFrame, order: str = "bar_date") -> DataFrame:
    """Bars dealt by symbol and year before a write partitioned by symbol: a file per symbol and
    year at most, and no symbol in one task."""
    return bars.repartition(F.col("symbol"), F.year(order))


def bars_from_orders(orders: DataFrame) -> DataFrame:
    """Daily bars from ``orders``: one series per order priority.

    open/close are the first/last order of the day by ``o_orderkey`` (several
    orders share a day, so the key breaks the tie); volume is the order count.
    Partial (map-side) aggregation keeps the shuffle at one row per task and
    (symbol, day), whatever the skew of one priority.
    """
    return orders.groupBy(
        F.col("o_orderpriority").alias("symbol"),
        F.to_date("o_orderdate").alias("bar_date"),
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def bars_from_events(events: DataFrame) -> DataFrame:
    """Hourly bars from ``events``: one series per event type, ordered by ``bar_ts``.

    The hour is cut on the zone-free timestamp, so no session zone's clock change merges hours.
    First and last are by (time in the hour, event id), packed in one decimal: its buffer has a fixed
    width, so the raw events are aggregated by hash, where a struct would have them sorted."""
    ts = F.col("ts").cast("timestamp_ntz")
    order = F.expr("""coalesce(cast((minute(ts) * 60 + extract(SECOND FROM ts)) * 1000000 AS decimal(10, 0)), 0)
                      * cast('10000000000000000000' AS decimal(20, 0)) + coalesce(cast(event_id AS decimal(19, 0)), 0)""")
    return events.groupBy(
        F.col("event_type").alias("symbol"),
        F.make_timestamp_ntz(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.lit(0), F.lit(0)).alias("bar_ts"),
    ).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def _as_date(d: str | dt.date | Column) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def bars_date_range(bars: DataFrame, start, end, order: str = "bar_date") -> DataFrame:
    """Keep bars with ``start <= bar_date <= end`` (both inclusive).

    A plain comparison on the order column, so Catalyst pushes it into the
    parquet scan (row-group / partition pruning).
    """
    return bars.filter((F.col(order) >= _as_date(start)) & (F.col(order) <= _as_date(end)))


def orders_date_range(orders: DataFrame, start, end, ts_col: str = "o_orderdate") -> DataFrame:
    """S2 pushed below the bar aggregation: a half-open range on the raw
    timestamp column, ``start <= ts < end + 1 day``, which the parquet reader
    can use for row-group pruning (a filter on the derived ``bar_date`` cannot
    reach the scan)."""
    s = start if isinstance(start, dt.date) else dt.date.fromisoformat(start)
    e = (end if isinstance(end, dt.date) else dt.date.fromisoformat(end)) + dt.timedelta(days=1)
    lo = F.lit(dt.datetime(s.year, s.month, s.day).isoformat(sep=" ")).cast("timestamp_ntz")
    hi = F.lit(dt.datetime(e.year, e.month, e.day).isoformat(sep=" ")).cast("timestamp_ntz")
    return orders.filter((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def bars_window_for(as_of, years: int) -> tuple[dt.date, dt.date]:
    """The reference's default range, with an explicit ``as_of`` instead of the clock."""
    as_of = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)
    return as_of - dt.timedelta(days=365 * years), as_of


def write_bar_store(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 (write side): bar store partitioned by symbol, so a per-ticker read
    prunes to one folder."""
    by_symbol(bars).write.mode(mode).partitionBy("symbol").parquet(path)


def read_bar_store(spark: SparkSession, path: str, symbols: list[str] | None = None,
                   start=None, end=None) -> DataFrame:
    """S3 (read side): partition pruning on ``symbol``, pushed filters on dates."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    if start is not None and end is not None:
        df = bars_date_range(df, start, end)
    return df.select(*BAR_COLUMNS)


def manifest_from_bars(bars: DataFrame) -> DataFrame:
    """A store manifest ``(symbol, range_start, range_end, written_at)``: one
    entry per symbol and calendar year of bars, written the day after the range
    ends.  It stands for the reference's file cache entries."""
    return bars.groupBy("symbol", F.year("bar_date").alias("range_year")).agg(
        F.min("bar_date").alias("range_start"),
        F.max("bar_date").alias("range_end"),
    ).select(
        "symbol", "range_start", "range_end",
        F.date_add("range_end", 1).cast("timestamp_ntz").alias("written_at"),
    )


def cache_fresh_filter(manifest: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """A cached range is usable when it ended before ``as_of`` or was written
    less than one whole day before ``as_of``; of the usable entries the latest
    written one per symbol wins."""
    as_of = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(as_of)
    as_of_ts = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    age_days = F.floor(F.timestamp_diff("SECOND", F.col("written_at"), as_of_ts) / 86400)
    usable = (F.col("range_end") < F.to_date(as_of_ts)) | (age_days < 1)
    w = Window.partitionBy("symbol").orderBy(F.col("written_at").desc(), F.col("range_start").desc())
    return (
        manifest.filter(usable)
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def missing_symbols(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """S5 per series: requested symbols with no bar (left anti join)."""
    return requested.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def require_nonempty(bars: DataFrame, what: str = "bars") -> DataFrame:
    """S5 per job: raise when the input has no rows (one cheap ``isEmpty`` probe)."""
    if bars.isEmpty():
        raise ValueError(f"No data found for {what} in the specified range")
    return bars
