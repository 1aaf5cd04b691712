"""The block layout must give the same answers as one window per series."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paths import SF001, SF1
from orrery.operators.indicators import INDICATOR_COLUMNS, indicators_all
from orrery.plans.sequence import Series, layout, over_series
from orrery.sources.bars import bars_from_orders


def _bars(spark, sf=SF1):
    return bars_from_orders(spark.read.parquet(f"{sf}/orders.parquet"))


def test_ordinal_is_series_wide(spark):
    bars = _bars(spark)
    laid = over_series(bars, lambda d, s: d, Series(), back=0, ahead=0, block_rows=100, keep_ordinal=True)
    got = laid.select("symbol", "bar_date", "rn").toPandas().sort_values(["symbol", "bar_date"])
    want = got.groupby("symbol").cumcount()
    assert (got["rn"].values == want.values).all()
    assert len(got) == bars.count()


def test_halo_rows_cover_lookback(spark):
    bars = _bars(spark)
    laid = layout(bars, Series(), back=300, ahead=40, block_rows=500)
    own = laid.filter("_own").count()
    assert own == bars.count()
    # every non-first block carries at least `back` halo rows before its own rows
    pdf = laid.select("symbol", "_blk", "_own", "rn").toPandas()
    for (sym, blk), g in pdf.groupby(["symbol", "_blk"]):
        first_own = g.loc[g["_own"], "rn"].min()
        before = (g["rn"] < first_own).sum()
        assert first_own == 0 or before >= 300


def test_multi_block_equals_single_block(spark):
    bars = _bars(spark)
    one = indicators_all(bars, block_rows=1 << 16).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
    many = indicators_all(bars, block_rows=1024).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
    assert len(one) == len(many) == bars.count()
    for c in INDICATOR_COLUMNS:
        a, b = one[c].astype(float).values, many[c].astype(float).values
        assert (np.isnan(a) == np.isnan(b)).all(), c
        m = ~np.isnan(a)
        assert np.allclose(a[m], b[m], rtol=1e-12, atol=1e-9), c


def test_block_shuffle_is_by_key_and_block(spark):
    bars = _bars(spark)
    plan = indicators_all(bars)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_blk" in plan


def test_hot_series_spreads_over_tasks(spark):
    """One series cut into blocks runs in several tasks, each holding at most a
    block plus its halo and one chunk (a hot symbol never lands in one task)."""
    bars = _bars(spark).filter(F.col("symbol") == "1-URGENT")
    n = bars.count()
    laid = layout(bars, Series(), back=64, ahead=0, block_rows=64, chunk_unit="day")
    # AQE would merge these tiny partitions into one; at scale they are large
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_part = laid.select(F.spark_partition_id().alias("pid"), "_blk").groupBy("pid").agg(
            F.countDistinct("_blk").alias("blocks"), F.count(F.lit(1)).alias("rows")
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(per_part) > 1
    assert max(r["rows"] for r in per_part) < n
    per_block = laid.groupBy("_blk").count().collect()
    assert len(per_block) >= n // 64
    assert max(r["count"] for r in per_block) <= 64 + 64 + 1


def test_stream_bars_do_not_depend_on_session_time_zone(spark):
    """The streaming daily bars equal the batch bars' days in any session zone."""
    from orrery.catalog.series import q_bars_stream_append

    batch = {tuple(r) for r in _bars(spark, SF001).collect()}
    seen = {}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            seen[tz] = {tuple(r) for r in q_bars_stream_append(spark, SF001).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen["UTC"] == seen["Asia/Tokyo"] == seen["America/Los_Angeles"]
    assert seen["UTC"] == batch


def _uneven(spark, sizes, base="2001-01-01"):
    """One series with ``sizes[m]`` rows in month m, and the plain pandas frame."""
    rows = []
    for m, n in enumerate(sizes):
        first = pd.Timestamp(base) + pd.DateOffset(months=m)
        rows += [("S", (first + pd.Timedelta(minutes=k)).to_pydatetime(), float((7 * len(rows) + 3 * k) % 101)) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp, x double"), pd.DataFrame(rows, columns=["symbol", "bar_ts", "x"])


def test_halo_reaches_over_short_blocks(spark):
    """Chunks nearly as big as a block make short blocks behind them; frames still see all rows."""
    from orrery.operators import windows as W

    df, plain = _uneven(spark, [99, 95, 13, 50, 60])
    s = Series("symbol", "bar_ts")
    def build(d, s):
        return d.withColumns({"mean50": F.avg("x").over(s.rows(50)), "lag21": F.lag("x", 21).over(s.w), "lead30": F.lead("x", 30).over(s.w)})
    got = over_series(df, build, s, back=60, ahead=40, block_rows=100).toPandas().sort_values("bar_ts")
    x = plain["x"]
    for column, want in (("mean50", x.rolling(50, min_periods=1).mean()), ("lag21", x.shift(21)), ("lead30", x.shift(-30))):
        assert np.allclose(got[column].astype(float).values, want.values, equal_nan=True), column


def test_null_keys_and_orders_stay(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, pd.Timestamp("2001-01-02").to_pydatetime(), 2.0), ("S", None, 3.0)],
                               "symbol string, bar_ts timestamp, x double")
    out = over_series(df, lambda d, s: d, Series("symbol", "bar_ts"), back=2, ahead=1, block_rows=2, keep_ordinal=True)
    assert sorted((r.x, r.rn) for r in out.collect()) == [(1.0, 0), (2.0, 1), (3.0, 0)]


def test_long_ema_span_is_refused(spark):
    import pytest

    from orrery.operators.ewma import with_ewma

    df, _ = _uneven(spark, [10])
    with pytest.raises(ValueError):
        over_series(df, lambda d, s: with_ewma(d, "x", "y", 2000, s), Series("symbol", "bar_ts"))


def test_hourly_bars_keep_hours_apart_at_a_clock_change(spark):
    from orrery.sources.bars import bars_from_events

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = spark.sql("""SELECT * FROM VALUES (1L, 'view', TIMESTAMP_NTZ'2023-03-12 02:15:00', 1D),
            (2L, 'view', TIMESTAMP_NTZ'2023-03-12 03:15:00', 2D) AS t(event_id, event_type, ts, value)""")
        assert bars_from_events(events).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_late_order_files_reach_the_ingested_bars(spark, tmp_path):
    """A second run with the older files: the store equals the batch bars."""
    from orrery.streaming.bars import read_ingested, start_bar_ingest

    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    for part in ("o_orderdate >= TIMESTAMP_NTZ'1998-01-01'", "o_orderdate < TIMESTAMP_NTZ'1998-01-01'"):
        orders.where(part).write.mode("append").parquet(source)
        start_bar_ingest(spark, source, orders.schema, store, checkpoint).awaitTermination()
    assert {tuple(r) for r in read_ingested(spark, store).collect()} == {tuple(r) for r in _bars(spark, SF001).collect()}


def test_compacted_store_reads_the_same_and_keeps_taking_files(spark, tmp_path):
    from pathlib import Path

    from orrery.streaming import bars as SB

    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    assert SB.read_ingested(spark, store).count() == 0 and SB.compact_ingested(spark, store) == 0  # nothing written yet
    names = lambda: sorted(p.name for p in Path(store).iterdir() if not p.name.startswith("."))
    rows = lambda d: {tuple(r) for r in d.collect()}
    for part in range(5):
        orders.where(f"o_orderkey % 5 = {part}").coalesce(1).write.mode("append").parquet(source)
        SB.start_bar_ingest(spark, source, orders.schema, store, checkpoint).awaitTermination()
        want = rows(SB.merged_bars(SB.partial_bars(orders.where(f"o_orderkey % 5 <= {part}"))))
        assert rows(SB.read_ingested(spark, store)) == want
        if part == 2:
            assert SB.compact_ingested(spark, store) == 2 and len(names()) == 2
            assert rows(SB.read_ingested(spark, store)) == want and SB.compact_ingested(spark, store) == 0
    stream = names()[0].split("-")[0]
    assert names() == [f"{stream}-0..1", f"{stream}-2", f"{stream}-3", f"{stream}-4"]
    # a compaction that ended before it removed what it had merged, and one that ended before it was in its place
    merged = SB.merged_partials(SB._read(spark, store, names()[:2]))
    merged.write.parquet(f"{store}/{stream}-0..2")
    merged.write.parquet(f"{store}/_compact-x")
    assert rows(SB.read_ingested(spark, store)) == want
    assert SB.compact_ingested(spark, store) == 4 and set(names()) == {f"{stream}-0..3", f"{stream}-4", "_compact-x"}
    assert rows(SB.read_ingested(spark, store)) == want


def test_bars_aggregate_raw_rows_by_hash(spark):
    from orrery.sources.bars import bars_from_events, bars_from_orders

    for bars, name in ((bars_from_events, "events"), (bars_from_orders, "orders")):
        plan = bars(spark.read.parquet(f"{SF001}/{name}.parquet"))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
