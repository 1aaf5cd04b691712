"""Registered queries: feature sets, projections, splits and bar-store sources
(F1, F2, P1-P4, P7-P9, W10, W11, J5, A8, S3, S4)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.columns import where_negative_abs, where_positive
from ..operators import arrival as A
from ..operators import features as FE
from ..operators import indicators as I
from ..operators import windows as W
from ..operators.enrich import landscape
from ..plans.sequence import Series, over_series
from ..session import scratch_path
from ..sources import bars as B
from ..sources import scenarios as SC
from .arrival import chain_sql, years_cte
from .common import BARS_SQL, dbl, full_window_sql, orders_bars, register, table
from .series import INDICATORS_SQL, IND_ROUND

S = Series("symbol", "bar_date")
LAND_BASE = 2025

F1_ROUND = {"ma50": 6, "ma200": 6, "rsi": 6, "volatility": 6, **{f"momentum_{k}": 6 for k in FE.MOMENTUM_PERIODS},
            "agi_probability": 6, FE.TARGET: 6}


def landscape_of(spark, sf):
    """U4 for the feature constants at base year 2025: per symbol, all scenarios it is exposed to."""
    li = table(spark, sf, "lineitem")
    post = A.posterior_moments(*SC.scenario_inputs(li, LAND_BASE))
    plan = SC.exposure_plan(table(spark, sf, "orders"), li)
    return plan.join(landscape(A.horizon_probability(post)), "scenario_id")


def f0_of(spark, sf):
    """F1 without the scenarios' constants: what the splits are made on."""
    return FE.features_pipeline(orders_bars(spark, sf), None, S)


def f1_of(spark, sf):
    return FE.features_pipeline(orders_bars(spark, sf), landscape_of(spark, sf), S)


def rounded(df, spec, keys=("symbol", "bar_date")):
    cols = [F.round(F.col(c), spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns]
    return df.select(*cols)


def lag_sql(extended: bool, p: str = "b.", a: str = "a.") -> str:
    parts = []
    for k in FE.LAG_PERIODS:
        parts.append(f"lag({p}close, {k}) OVER w AS close_lag_{k}")
        parts.append(f"lag({p}volume, {k}) OVER w AS volume_lag_{k}")
        if extended:
            parts.append(f"lag({a}rsi, {k}) OVER w AS rsi_lag_{k}")
    for k in FE.MOMENTUM_PERIODS:
        parts.append(f"{p}close / lag({p}close, {k}) OVER w - 1 AS momentum_{k}")
    if extended:
        parts += [f"CAST(isodow({p}bar_date) - 1 AS INTEGER) AS day_of_week",
                  f"CAST(month({p}bar_date) AS INTEGER) AS month",
                  f"{p}close / lag({p}close) OVER w - 1 AS return_1d"]
    parts.append(f"lead({p}close, 30) OVER w / {p}close - 1 AS {FE.TARGET}")
    return ", ".join(parts)


def _sel(cols, spec):
    return ", ".join(f"round({c}, {spec[c]}) AS {c}" if c in spec else c for c in cols)


F0_COLS = ["symbol", "bar_date", *FE.feature_columns(constants=False), FE.TARGET]
F1_COLS = ["symbol", "scenario_id", "bar_date", *FE.feature_columns(), FE.TARGET]
F1_SQL_BODY = (
    INDICATORS_SQL
    + ", "
    + chain_sql(LAND_BASE)
    + years_cte("ypl", 0, 15)
    + f""",
land AS (SELECT symbol, scenario_id, {dbl(0.75)} AS ai_sentiment, cumulative_probability AS agi_probability
         FROM ypl JOIN (SELECT DISTINCT o_orderpriority AS symbol, l_returnflag AS scenario_id
                        FROM orders JOIN lineitem ON l_orderkey = o_orderkey) USING (scenario_id)
         WHERE year = {LAND_BASE + 5}),
raw AS (
  SELECT b.symbol, b.bar_date, b.open, b.high, b.low, b.close, b.volume, a.ma50, a.ma200, a.rsi, a.volatility,
         {lag_sql(False)}
  FROM bars b JOIN all_ind a USING (symbol, bar_date)
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar_date)
),
f0 AS (SELECT * FROM raw WHERE {" AND ".join(f"{c} IS NOT NULL" for c in F0_COLS)}),
f1 AS (SELECT f0.*, land.scenario_id, land.ai_sentiment, land.agi_probability FROM f0 JOIN land USING (symbol))"""
)


@register("features_pipeline", F1_SQL_BODY + f" SELECT {_sel(F1_COLS, F1_ROUND)} FROM f1")
def q_features_pipeline(spark, sf):
    return rounded(f1_of(spark, sf).select(*F1_COLS), F1_ROUND)


F2_COLS = ["symbol", "bar_date", *FE.feature_columns(extended=True), FE.TARGET]
F2_ROUND = {**IND_ROUND, **{f"rsi_lag_{k}": 6 for k in FE.LAG_PERIODS},
            **{f"momentum_{k}": 6 for k in FE.MOMENTUM_PERIODS}, "return_1d": 6, FE.TARGET: 6}


@register(
    "features_extended",
    INDICATORS_SQL
    + f""",
raw2 AS (
  SELECT b.symbol, b.bar_date, b.open, b.high, b.low, b.close, b.volume,
         {", ".join("a." + c for c in I.INDICATOR_COLUMNS)}, {lag_sql(True)}
  FROM bars b JOIN all_ind a USING (symbol, bar_date)
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar_date)
)
SELECT {_sel(F2_COLS, F2_ROUND)} FROM raw2 WHERE {" AND ".join(f"{c} IS NOT NULL" for c in F2_COLS)}""",
)
def q_features_extended(spark, sf):
    return rounded(FE.features_extended(orders_bars(spark, sf), S).select(*F2_COLS), F2_ROUND)


# --- P1-P4, P7-P9, J5 ---------------------------------------------------------------

P1_ROUND = {"ma50": 6, "ma200": 6, "rsi": 6, "volatility": 6}


@register(
    "project_columns",
    INDICATORS_SQL + f""" SELECT b.symbol, b.bar_date, b.open, b.high, b.low, b.close, b.volume,
        round(a.ma50, 6) AS ma50, round(a.ma200, 6) AS ma200, round(a.rsi, 6) AS rsi, round(a.volatility, 6) AS volatility
        FROM bars b JOIN all_ind a USING (symbol, bar_date)""",
)
def q_project_columns(spark, sf):
    """Keys + the nine base columns of the indicator table."""
    ind = I.indicators_all(orders_bars(spark, sf), S)
    return rounded(FE.project_columns(ind), P1_ROUND)


@register(
    "with_columns",
    f"""SELECT *, round(high - low, 6) AS day_range, round((high + low) / 2, 6) AS mid_price,
               round(close / open - 1, 6) AS day_return FROM ({BARS_SQL})""",
)
def q_with_columns(spark, sf):
    """Derived columns appended in one projection."""
    b = orders_bars(spark, sf)
    return b.withColumns(
        {
            "day_range": F.round(F.col("high") - F.col("low"), 6),
            "mid_price": F.round((F.col("high") + F.col("low")) / 2, 6),
            "day_return": F.round(F.col("close") / F.col("open") - 1, 6),
        }
    )


P3_COLS = [c for c in F1_COLS if c != FE.TARGET]


@register("drop_target", F1_SQL_BODY + f" SELECT {_sel(P3_COLS, F1_ROUND)} FROM f1")
def q_drop_target(spark, sf):
    return rounded(FE.drop_target(f1_of(spark, sf)).select(*P3_COLS), F1_ROUND)


@register(
    "drop_any_null",
    f"""SELECT * FROM (SELECT symbol, bar_date, lag(close, 21) OVER w AS close_lag_21,
               round(lead(close, 30) OVER w / close - 1, 6) AS {FE.TARGET}
               FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))
        WHERE close_lag_21 IS NOT NULL AND {FE.TARGET} IS NOT NULL""",
)
def q_drop_any_null(spark, sf):
    """Rows with any NULL removed (warm-up and the last 30 target rows)."""
    def build(d, s):
        return d.withColumns({"close_lag_21": W.lag("close", s, 21),
                              FE.TARGET: F.round(W.lead_return("close", s, 30), 6)})

    out = over_series(orders_bars(spark, sf), build, S, back=32, ahead=32)
    return out.select("symbol", "bar_date", "close_lag_21", FE.TARGET).dropna("any")


@register(
    "constant_features",
    F1_SQL_BODY.split(",\nraw AS (")[0]
    + f""" SELECT b.symbol, land.scenario_id, b.bar_date, land.ai_sentiment, round(land.agi_probability, 6) AS agi_probability
           FROM bars b JOIN land USING (symbol)""",
)
def q_constant_features(spark, sf):
    """The two landscape scalars of every scenario on every bar."""
    b = orders_bars(spark, sf).select("symbol", "bar_date")
    out = FE.with_constants(b, landscape_of(spark, sf))
    return out.select("symbol", "scenario_id", "bar_date", "ai_sentiment", F.round("agi_probability", 6).alias("agi_probability"))


REPORT_YEARS = (2030, 2035, 2040, 2050, 2060)


@register(
    "defaults",
    "WITH "
    + chain_sql(LAND_BASE)
    + years_cte("ys", 0, 30, 5)
    + f"""
    SELECT p.scenario_id, t.year, round(coalesce(ys.cumulative_probability, 0), 6) AS probability
    FROM (SELECT DISTINCT scenario_id FROM post) p CROSS JOIN (VALUES {", ".join(f"({y})" for y in REPORT_YEARS)}) t(year)
    LEFT JOIN ys ON ys.scenario_id = p.scenario_id AND ys.year = t.year""",
)
def q_defaults(spark, sf):
    """Report years looked up in the 5-year stride table, 0 when the year
    is not one of the strides (the reference's ``.get(key, 0)``)."""
    li = table(spark, sf, "lineitem")
    post = A.posterior_moments(*SC.scenario_inputs(li, LAND_BASE))
    stride = A.year_probabilities(post, 0, 30, 5)
    want = post.select("scenario_id", F.explode(F.array(*[F.lit(y) for y in REPORT_YEARS])).alias("year"))
    j = want.join(stride, ["scenario_id", "year"], "left")
    return j.select("scenario_id", "year", F.round(F.coalesce("cumulative_probability", F.lit(0.0)), 6).alias("probability"))


@register(
    "where_zero",
    f"""SELECT symbol, bar_date,
               round(CASE WHEN close - lag(close) OVER w > 0 THEN close - lag(close) OVER w ELSE 0 END, 6) AS gain,
               round(CASE WHEN close - lag(close) OVER w < 0 THEN -(close - lag(close) OVER w) ELSE 0 END, 6) AS loss
        FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)""",
)
def q_where_zero(spark, sf):
    """Positive / negative parts of the daily change, NULL counted as 0."""
    def build(d, s):
        delta = W.diff("close", s)
        return d.withColumns({"gain": F.round(where_positive(delta), 6), "loss": F.round(where_negative_abs(delta), 6)})

    return over_series(orders_bars(spark, sf), build, S, back=8, ahead=0).select("symbol", "bar_date", "gain", "loss")


@register(
    "hconcat_rowmax",
    f"""SELECT symbol, bar_date, round(high - low, 6) AS high_low,
               round(abs(high - lag(close) OVER w), 6) AS high_close, round(abs(low - lag(close) OVER w), 6) AS low_close,
               round(greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0),
                              coalesce(abs(low - lag(close) OVER w), 0)), 6) AS true_range
        FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)""",
)
def q_hconcat_rowmax(spark, sf):
    """Three aligned series and their row maximum (same-row ``greatest``,
    which skips the NULL of the first row)."""
    def build(d, s):
        prev = W.lag("close", s, 1)
        return d.withColumns(
            {
                "high_low": F.round(F.col("high") - F.col("low"), 6),
                "high_close": F.round(F.abs(F.col("high") - prev), 6),
                "low_close": F.round(F.abs(F.col("low") - prev), 6),
                "true_range": F.round(I.true_range(s), 6),
            }
        )

    out = over_series(orders_bars(spark, sf), build, S, back=8, ahead=0)
    return out.select("symbol", "bar_date", "high_low", "high_close", "low_close", "true_range")


# --- W10, W11, A8 --------------------------------------------------------------------

def _split_sql(rule: str) -> str:
    if rule == "ceil":
        n_train = f"n - ceil(n * {dbl(0.2)})"
    else:
        n_train = f"floor(n * {dbl(1.0 - 0.2)})"
    return F1_SQL_BODY + f"""
    SELECT symbol, bar_date, rn >= {n_train} AS is_test FROM (
      SELECT symbol, bar_date, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS rn,
             count(*) OVER (PARTITION BY symbol) AS n FROM f0)"""


@register("chronological_split_ceil", _split_sql("ceil"))
def q_split_ceil(spark, sf):
    return FE.features_with_split(orders_bars(spark, sf), S, 0.2, "ceil").select("symbol", "bar_date", "is_test")


@register("chronological_split_floor", _split_sql("floor"))
def q_split_floor(spark, sf):
    return FE.features_with_split(orders_bars(spark, sf), S, 0.2, "floor").select("symbol", "bar_date", "is_test")


@register(
    "counts_minmax",
    f"""SELECT symbol, count(*) AS n_bars, min(bar_date) AS first_date, max(bar_date) AS last_date,
               CAST(min(year(bar_date)) AS INTEGER) AS first_year, CAST(max(year(bar_date)) AS INTEGER) AS last_year
        FROM ({BARS_SQL}) GROUP BY 1""",
)
def q_counts_minmax(spark, sf):
    """Row count and date/year extent per series."""
    b = orders_bars(spark, sf)
    return b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"),
        F.min(F.year("bar_date")).alias("first_year"), F.max(F.year("bar_date")).alias("last_year"),
    )


# --- S3, S4 ---------------------------------------------------------------------------

STORE_SYMBOLS = ["1-URGENT", "3-MEDIUM"]
STORE_START, STORE_END = dt.date(1997, 1, 1), dt.date(1999, 12, 31)


@register(
    "bars_store_roundtrip",
    f"""SELECT * FROM ({BARS_SQL}) WHERE symbol IN ({", ".join(f"'{s}'" for s in STORE_SYMBOLS)})
        AND bar_date BETWEEN DATE '{STORE_START}' AND DATE '{STORE_END}'""",
)
def q_bars_store_roundtrip(spark, sf):
    """S3: write the bar store partitioned by symbol, read two tickers back
    (partition pruning) for a date range (pushed filter)."""
    path = scratch_path(spark, f"bar-store-{uuid.uuid4().hex}")
    B.write_bar_store(orders_bars(spark, sf), path)
    return B.read_bar_store(spark, path, STORE_SYMBOLS, STORE_START, STORE_END)


AS_OF = dt.datetime(1999, 6, 15, 12, 0, 0)


@register(
    "cache_fresh_filter",
    f"""SELECT symbol, range_start, range_end, written_at FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY written_at DESC, range_start DESC) AS k FROM (
            SELECT symbol, min(bar_date) AS range_start, max(bar_date) AS range_end,
                   CAST(max(bar_date) + 1 AS TIMESTAMP) AS written_at
            FROM ({BARS_SQL}) GROUP BY symbol, year(bar_date))
          WHERE range_end < DATE '{AS_OF.date()}'
             OR floor((epoch(TIMESTAMP '{AS_OF}') - epoch(written_at)) / 86400) < 1)
        WHERE k = 1""",
)
def q_cache_fresh_filter(spark, sf):
    """Usable cache entries as of a fixed time, latest per symbol."""
    return B.cache_fresh_filter(B.manifest_from_bars(orders_bars(spark, sf)), AS_OF)
