"""Series with missing values, dense chunks of ticks and the interval cover of the bar cache."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import cover as C
from orrery.operators.ewma import ewma_over_gaps, slowest_decay, with_ewma
from orrery.plans.sequence import Series, layout, over_series

TICKS = Series("symbol", "ts")


def _pandas_ewm(values, span):
    return pd.Series(values, dtype="float64").ewm(span=span, adjust=False, ignore_na=False).mean().to_numpy()


def test_mean_over_gaps_equals_pandas(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for symbol, n, share in (("a", 6000, 0.3), ("b", 900, 0.97), ("c", 40, 0.5), ("d", 50, 1.0), ("e", 3000, 0.0)):
        values = [None if rng.random() < share else float(v) for v in rng.normal(100, 10, n)]
        if symbol == "a":
            values[:5] = [None] * 5  # no value yet
            values[2000:4700] = [None] * 2700  # longer than any halo and several blocks
            values[4705:5300] = [None] * 595
        start = dt.date(2000, 1, 1)
        rows += [(symbol, start + dt.timedelta(days=k), v) for k, v in enumerate(values)]
        want[symbol] = values
    df = spark.createDataFrame(rows, "symbol string, bar_date date, x double")
    for span, block in ((12, 500), (26, 700), (3, 1 << 16)):
        spans = {"y": span} if span != 12 else {"y": 12, "other": 5}
        got = ewma_over_gaps(df, "x", spans, block_rows=block).toPandas().sort_values(["symbol", "bar_date"])
        for symbol, values in want.items():
            y = got[got.symbol == symbol]["y"].to_numpy(dtype=float)
            expected = _pandas_ewm([np.nan if v is None else v for v in values], span)
            assert (np.isnan(y) == np.isnan(expected)).all(), (symbol, span)
            ok = ~np.isnan(y)
            assert np.allclose(y[ok], expected[ok], rtol=1e-13), (symbol, span)


def test_slowest_decay_is_the_worst_pattern():
    for span in (3, 12, 26):
        a = 2 / (span + 1)
        d = 1 - a
        assert slowest_decay(a) == max((d**g / (d**g + a)) ** (1 / g) for g in range(1, 5000) if d**g > 0)


def test_plain_mean_refuses_a_null(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 1, k), None if k == 3 else 1.0) for k in range(1, 9)], "symbol string, bar_date date, x double")
    with pytest.raises(Exception, match="ewma_over_gaps"):
        over_series(df, lambda d, s: with_ewma(d, "x", "y", 12, s)).collect()


def _ticks(spark, n=40_000):
    """90 % of all ticks in one month of one symbol, a third of them in one moment."""
    rng = random.Random(9)
    rows = []
    for k in range(n):
        if rng.random() < 0.9:
            second = 1_000_000 if rng.random() < 0.35 else int(rng.betavariate(2, 9) * 2_400_000)
            rows.append(("hot", dt.datetime(2024, 5, 1) + dt.timedelta(seconds=second), k))
        else:
            rows.append((rng.choice(["hot", "cold", None]), dt.datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23)), k))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v long")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_dense_chunk_is_split_and_rows_stay_in_order(spark, kind):
    ticks = _ticks(spark).withColumn("ts", F.col("ts").cast(kind))
    laid = layout(ticks, TICKS, back=50, ahead=10, block_rows=1024, max_chunk_rows=1024)
    per_block = laid.groupBy("symbol", "_blk").agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own")).toPandas()
    assert per_block.n.max() < 1024 + 50 + 10 + 3 * 110  # a block, its halo, and a part at each end
    assert per_block.own.sum() == 40_000
    atomic = layout(ticks, TICKS, back=0, ahead=0, block_rows=1024).groupBy("symbol", "_blk").count().agg(F.max("count")).head()[0]
    assert atomic > 30_000
    # every row once, numbered through, in order of time
    out = over_series(ticks, lambda d, s: d, TICKS, back=0, ahead=0, block_rows=1024, max_chunk_rows=1024, keep_ordinal=True).toPandas()
    out["symbol"] = out["symbol"].fillna("none")
    assert out.columns.tolist() == ["symbol", "ts", "v", "rn"] and sorted(out.v) == list(range(40_000))
    for _, g in out.groupby("symbol"):
        g = g.sort_values("rn")
        assert g.rn.tolist() == list(range(len(g))) and g.ts.is_monotonic_increasing


def test_windows_over_split_chunks_equal_one_block(spark):
    ticks = _ticks(spark, 6000).dropDuplicates(["symbol", "ts"]).withColumn("close", F.col("v").cast("double"))
    build = lambda d, s: d.withColumn("m", F.avg("close").over(s.rows(20)))
    one = over_series(ticks, build, TICKS, back=64, ahead=0).toPandas().sort_values("v").reset_index(drop=True)
    many = over_series(ticks, build, TICKS, back=64, ahead=0, block_rows=128, max_chunk_rows=128).toPandas().sort_values("v").reset_index(drop=True)
    assert np.allclose(one.m, many.m) and len(one) == len(many)


def _days(a, b):
    return [a + dt.timedelta(days=k) for k in range((b - a).days + 1)] if a and b and a <= b else []


def test_cover_gaps_and_fallback_by_days(spark):
    rng = random.Random(4)
    start = dt.date(1998, 11, 1)

    def ranges(n, most):
        out = []
        for _ in range(n):
            a = start + dt.timedelta(days=rng.randint(0, 900))
            out.append((rng.choice("xyz"), a, a + dt.timedelta(days=rng.randint(0, most))))
        return out

    entries = [(*r, dt.datetime.combine(r[2], dt.time()) - dt.timedelta(days=rng.randint(-2, 500))) for r in ranges(60, 40)]
    entries += [entries[0], ("x", None, start, None), ("y", start, start - dt.timedelta(days=3), dt.datetime(1999, 1, 1)), (None, start, start, None)]
    attempts = [(*r, rng.random() < 0.5) for r in ranges(40, 60)]
    requests = ranges(25, 700) + [("w", start, start), ("x", start, start - dt.timedelta(days=1))]
    requests.append(requests[0])
    as_of = dt.datetime(2000, 1, 1, 12)
    e = spark.createDataFrame(entries, "symbol string, range_start date, range_end date, written_at timestamp_ntz")
    t = spark.createDataFrame(attempts, "symbol string, range_start date, range_end date, ok boolean")
    q = spark.createDataFrame(requests, "symbol string, range_start date, range_end date")

    held = {(s, d) for s, a, b, _ in entries if s for d in _days(a, b)}
    fresh = {(s, d) for s, a, b, w in entries if s and a and (b < as_of.date() or (as_of - w).total_seconds() // 86400 < 1) for d in _days(a, b)}
    got = {(s, d) for s, a, b, ok in attempts if ok for d in _days(a, b)}
    cover = C.merged_cover(e).collect()
    assert {(r.symbol, d) for r in cover for d in _days(r.range_start, r.range_end)} == held
    for symbol in "xyz":
        mine = sorted((r.range_start, r.range_end) for r in cover if r.symbol == symbol)
        assert all(a[1] + dt.timedelta(days=1) < b[0] for a, b in zip(mine, mine[1:]))
    want = {(s, a, b, d): "cache" if (s, d) in fresh else "fetched" if (s, d) in got else "stale" if (s, d) in held else "missing"
            for s, a, b in requests for d in _days(a, b)}
    parts = C.served(q, e, t, as_of).collect()
    found = [((r.symbol, r.range_start, r.range_end, d), r.served_from) for r in parts for d in _days(r.part_start, r.part_end)]
    assert len(found) == len(want) and dict(found) == want
    empty = spark.createDataFrame([], e.schema)
    assert {r.served_from for r in C.served(q, empty, t.where("false"), as_of).collect()} == {"missing"}
    assert C.merged_cover(empty).count() == 0
