"""Indicators against an independent pandas calculation and property checks."""

import numpy as np
import pandas as pd

from paths import SF01
from orrery.operators.indicators import indicators_all
from orrery.sources.bars import bars_from_orders


def _reference_frame(g: pd.DataFrame) -> pd.DataFrame:
    cl = g["close"]
    out = pd.DataFrame(index=g.index)
    out["ma50"] = cl.rolling(50).mean()
    out["ma200"] = cl.rolling(200).mean()
    d = cl.diff()
    gain = d.where(d > 0, 0).rolling(14).mean()
    loss = -d.where(d < 0, 0).rolling(14).mean()
    out["rsi"] = 100 - 100 / (1 + gain / loss)
    out["volatility"] = cl.pct_change().rolling(20).std() * np.sqrt(252)
    out["bb_middle"] = cl.rolling(20).mean()
    sd = cl.rolling(20).std()
    out["bb_upper"] = out.bb_middle + 2 * sd
    out["bb_lower"] = out.bb_middle - 2 * sd
    out["ema12"] = cl.ewm(span=12, adjust=False).mean()
    out["ema26"] = cl.ewm(span=26, adjust=False).mean()
    out["macd"] = out.ema12 - out.ema26
    out["macd_signal"] = out.macd.ewm(span=9, adjust=False).mean()
    out["macd_hist"] = out.macd - out.macd_signal
    tr = pd.concat([g.high - g.low, (g.high - cl.shift()).abs(), (g.low - cl.shift()).abs()], axis=1).max(axis=1)
    out["atr"] = tr.rolling(14).mean()
    return out


def test_indicators_match_pandas(spark):
    bars = bars_from_orders(spark.read.parquet(f"{SF01}/orders.parquet"))
    got = indicators_all(bars).toPandas()
    b = bars.toPandas().sort_values(["symbol", "bar_date"])
    for sym, g in b.groupby("symbol"):
        ref = _reference_frame(g.set_index("bar_date"))
        mine = got[got.symbol == sym].set_index("bar_date").sort_index()
        assert len(mine) == len(ref)
        for c in ref.columns:
            a, r = mine[c].astype(float).values, ref[c].values
            assert (np.isnan(a) == np.isnan(r)).all(), (sym, c)
            m = ~np.isnan(r)
            scale = np.maximum(1.0, np.abs(r[m]))
            assert np.max(np.abs(a[m] - r[m]) / scale) < 1e-8, (sym, c)


def test_warmup_rows_and_properties(spark):
    bars = bars_from_orders(spark.read.parquet(f"{SF01}/orders.parquet"))
    pdf = indicators_all(bars).toPandas().sort_values(["symbol", "bar_date"])
    for _, g in pdf.groupby("symbol"):
        first = {c: int(np.argmax(g[c].notna().values)) + 1 for c in ["ma50", "ma200", "rsi", "volatility", "bb_middle", "atr", "ema12"]}
        assert first == {"ma50": 50, "ma200": 200, "rsi": 14, "volatility": 21, "bb_middle": 20, "atr": 14, "ema12": 1}
    m = pdf.bb_middle.notna()
    assert np.allclose(pdf.bb_upper[m] + pdf.bb_lower[m], 2 * pdf.bb_middle[m])
    r = pdf.rsi.dropna()
    assert ((r >= 0) & (r <= 100)).all()


def test_rsi_edge_series(spark):
    """Constant closes give NULL RSI; rising closes give 100."""
    import datetime as dt

    rows = []
    for i in range(20):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
        rows.append(("flat", d, 10.0, 10.0, 10.0, 10.0, 1))
        rows.append(("up", d, 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1))
    df = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    out = indicators_all(df).toPandas()
    assert out[out.symbol == "flat"].rsi.isna().all()
    up = out[out.symbol == "up"].sort_values("bar_date").rsi
    assert up.isna().sum() == 13 and (up.dropna() == 100.0).all()


def test_input_order_and_symbol_isolation(spark):
    bars = bars_from_orders(spark.read.parquet(f"{SF01}/orders.parquet"))
    base = indicators_all(bars).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
    shuffled = indicators_all(bars.orderBy("close")).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(base, shuffled, check_exact=False, rtol=1e-12)
    alone = indicators_all(bars.filter("symbol = '2-HIGH'")).toPandas().sort_values("bar_date").reset_index(drop=True)
    mix = base[base.symbol == "2-HIGH"].reset_index(drop=True)
    pd.testing.assert_frame_equal(alone, mix, check_exact=False, rtol=1e-12)
