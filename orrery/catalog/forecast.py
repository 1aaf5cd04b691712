"""Registered queries: forecast path, bands, milestones, summaries (G1-G6, J1,
W8, S8, S11, S15).

Plan: every order priority under each return-flag scenario its orders carry
(orders x lineitem on the order key).  The prediction is the deterministic
geometric-mean 30-row return per symbol, so results do not depend on the forest; the
forest-driven run is ``forecast_job``.  Base year 2002: the bars end in
mid-2001, so blocks in 2001 fall back to the last supplied year (2004) and
blocks in 2002 join their own year.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import arrival as A
from ..operators import forecast as G
from ..operators import windows as W
from ..plans.sequence import Series, over_series
from ..session import scratch_path
from ..sources import scenarios as SC
from .arrival import chain_sql, impact_cte, years_cte
from .common import BARS_SQL, dbl, orders_bars, register, table

BASE = 2002
DAYS = 365
S = Series("symbol", "bar_date")
N_YEARS = DAYS // 365 + 2


def rr(name, p):
    return F.round(F.col(name), p).alias(name)


def start_of(spark, sf):
    """Start rows ``(symbol, scenario_id, bar_date, close, predicted_return)``.

    G1's last bar and the stand-in prediction come out of one grouped
    aggregate over the target rows (one shuffle, partial aggregation), and a
    symbol without any valid 30-row return has no prediction and no start row.
    """
    bars = orders_bars(spark, sf).select("symbol", "bar_date", "close")
    tgt = over_series(bars, lambda d, s: d.withColumn("target_30d_return", W.lead_return("close", s, 30)), S,
                      back=0, ahead=32)
    t = F.col("target_30d_return")
    per_symbol = tgt.groupBy("symbol").agg(
        F.max_by(F.struct("bar_date", "close"), F.col("bar_date")).alias("_last"),
        (F.exp(F.avg(F.when(t > -1, F.log(1 + t)))) - 1).alias("predicted_return"),
        F.count(F.when(t > -1, F.lit(1))).alias("_valid"),
    )
    start = per_symbol.filter(F.col("_valid") > 0).select(
        "symbol", F.col("_last.bar_date").alias("bar_date"), F.col("_last.close").alias("close"), "predicted_return"
    )
    plan = SC.exposure_plan(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return plan.join(start, "symbol")


def post_of(spark, sf):
    return A.posterior_moments(*SC.scenario_inputs(table(spark, sf, "lineitem"), BASE))


def impact_of(spark, sf, post=None):
    """D10 for the forecast's years; a query that needs the posterior too passes its own, so that the
    statistics are written once."""
    return A.impact_factor(A.year_probabilities(post if post is not None else post_of(spark, sf), 0, N_YEARS))


def path_of(spark, sf):
    return G.forecast_path(start_of(spark, sf), impact_of(spark, sf), DAYS)


# --- DuckDB oracle ------------------------------------------------------------------

FORECAST_SQL = (
    "WITH "
    + chain_sql(BASE)
    + years_cte("ypf", 0, N_YEARS)
    + impact_cte("impf", "ypf")
    + f""",
bars AS ({BARS_SQL}),
tgt AS (SELECT symbol, lead(close, 30) OVER (PARTITION BY symbol ORDER BY bar_date) / close - 1 AS t FROM bars),
pred AS (SELECT symbol, exp(avg(ln(1 + t))) - 1 AS predicted_return FROM tgt WHERE t > -1 GROUP BY 1),
last AS (SELECT symbol, max(bar_date) AS bar_date, arg_max(close, bar_date) AS close FROM bars GROUP BY 1),
plan AS (SELECT DISTINCT o_orderpriority AS symbol, l_returnflag AS scenario_id
         FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
start AS (SELECT * FROM plan JOIN last USING (symbol) JOIN pred USING (symbol)),
fb AS (SELECT scenario_id, arg_max(stock_impact_factor, year) AS fallback_factor FROM impf GROUP BY 1),
steps AS (
  SELECT s.*, CAST(g.step AS INTEGER) AS step, CAST(s.bar_date + CAST(1 + g.step AS INTEGER) AS DATE) AS forecast_date,
         CAST(g.step // 30 AS INTEGER) AS block,
         CAST(year(s.bar_date + CAST(1 + 30 * (g.step // 30) AS INTEGER)) AS INTEGER) AS block_year
  FROM start s CROSS JOIN range({DAYS}) g(step)
),
joined AS (
  SELECT st.*, coalesce(i.stock_impact_factor, fb.fallback_factor) AS impact_factor,
         st.predicted_return * (1 + coalesce(i.stock_impact_factor, fb.fallback_factor)) AS adj
  FROM steps st LEFT JOIN impf i ON i.scenario_id = st.scenario_id AND i.year = st.block_year
  LEFT JOIN fb ON fb.scenario_id = st.scenario_id
),
path AS (
  SELECT symbol, scenario_id, step, forecast_date, block, block_year, impact_factor, close,
         CASE WHEN block >= 1 THEN adj END AS adjusted_return,
         CASE WHEN sum(CASE WHEN block >= 1 AND NOT (1 + adj > 0) THEN 1 ELSE 0 END) OVER w = 0
              THEN close * exp(sum(CASE WHEN block >= 1 AND 1 + adj > 0 THEN ln(1 + adj) / 30 ELSE {dbl(0)} END) OVER w)
         END AS forecasted_close
  FROM joined
  WINDOW w AS (PARTITION BY symbol, scenario_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""
)


def fsql(final: str) -> str:
    return FORECAST_SQL + final


# --- G1, S8 ---------------------------------------------------------------------

@register(
    "latest_row",
    f"""SELECT symbol, max(bar_date) AS bar_date, arg_max(open, bar_date) AS open, arg_max(high, bar_date) AS high,
               arg_max(low, bar_date) AS low, arg_max(close, bar_date) AS close, arg_max(volume, bar_date) AS volume
        FROM ({BARS_SQL}) GROUP BY 1""",
)
def q_latest_row(spark, sf):
    return G.latest_row(orders_bars(spark, sf))


@register(
    "calendar_spine",
    f"""SELECT symbol, CAST(g.step AS INTEGER) AS step, CAST(bar_date + CAST(1 + g.step AS INTEGER) AS DATE) AS forecast_date
        FROM (SELECT symbol, max(bar_date) AS bar_date FROM ({BARS_SQL}) GROUP BY 1) CROSS JOIN range({DAYS}) g(step)""",
)
def q_calendar_spine(spark, sf):
    from ..sources.spines import calendar_spine

    last = G.latest_row(orders_bars(spark, sf).select("symbol", "bar_date"))
    return calendar_spine(last, DAYS).select("symbol", "step", "forecast_date")


# --- J1, G2, G3, W8, G4, G5, G6 ----------------------------------------------------------

@register(
    "year_join_with_fallback",
    fsql("SELECT symbol, scenario_id, block, block_year, round(impact_factor, 6) AS impact_factor FROM path WHERE step = block * 30 AND block >= 1"),
)
def q_year_join_with_fallback(spark, sf):
    start = start_of(spark, sf)
    blocks = start.select("symbol", "scenario_id", "bar_date", F.explode(F.sequence(F.lit(1), F.lit((DAYS - 1) // 30))).alias("block"))
    blocks = blocks.withColumn("block_year", F.year(F.date_add("bar_date", 1 + 30 * F.col("block"))))
    j = G.year_join_with_fallback(blocks, impact_of(spark, sf))
    return j.select("symbol", "scenario_id", "block", "block_year", rr("impact_factor", 6))


@register(
    "adjusted_return",
    fsql("SELECT DISTINCT symbol, scenario_id, block, round(adjusted_return, 9) AS adjusted_return FROM path WHERE block >= 1"),
)
def q_adjusted_return(spark, sf):
    p = path_of(spark, sf).filter(F.col("block") >= 1)
    return p.select("symbol", "scenario_id", "block", rr("adjusted_return", 9)).distinct()


@register(
    "forecast_path",
    fsql("SELECT symbol, scenario_id, step, forecast_date, round(forecasted_close, 2) AS forecasted_close FROM path"),
)
def q_forecast_path(spark, sf):
    return path_of(spark, sf).select("symbol", "scenario_id", "step", "forecast_date", rr("forecasted_close", 2))


@register(
    "compound_path",
    fsql("SELECT symbol, scenario_id, step, round(forecasted_close / close, 9) AS cumulative_factor FROM path"),
)
def q_compound_path(spark, sf):
    p = path_of(spark, sf)
    return p.select("symbol", "scenario_id", "step", F.round(F.col("forecasted_close") / F.col("last_close"), 9).alias("cumulative_factor"))


@register(
    "uncertainty_band",
    fsql(
        f"""SELECT symbol, scenario_id, step,
                   round(forecasted_close * (1 + {dbl(0.2)} * sqrt(step / {dbl(252)})), 2) AS upper_bound,
                   round(forecasted_close * (1 - {dbl(0.2)} * sqrt(step / {dbl(252)})), 2) AS lower_bound FROM path"""
    ),
)
def q_uncertainty_band(spark, sf):
    b = G.uncertainty_band(path_of(spark, sf))
    return b.select("symbol", "scenario_id", "step", rr("upper_bound", 2), rr("lower_bound", 2))


@register(
    "milestones",
    fsql(
        """SELECT symbol, scenario_id, step, forecast_date, strftime(forecast_date, '%b %Y') AS label,
                  round(forecasted_close, 2) AS forecasted_close FROM path WHERE step IN (90, 180)"""
    ),
)
def q_milestones(spark, sf):
    m = G.milestones(path_of(spark, sf), DAYS)
    return m.select("symbol", "scenario_id", "step", "forecast_date", "label", rr("forecasted_close", 2))


def summary_sql() -> str:
    cols = []
    for label, d in G.HORIZONS.items():
        if d < DAYS:
            price = f"max(CASE WHEN p.step = {d - 1} THEN p.forecasted_close END)"
            cols.append(f'round({price}, 2) AS "{label}_price"')
            cols.append(f'round(({price} / max(p.close) - 1) * 100, 6) AS "{label}_return_pct"')
        else:
            cols.append(f'CAST(NULL AS DOUBLE) AS "{label}_price"')
            cols.append(f'CAST(NULL AS DOUBLE) AS "{label}_return_pct"')
    return fsql(
        f"""SELECT p.symbol, p.scenario_id, max(p.close) AS current_price,
                   CAST(max(s.bar_date) + 1 AS DATE) AS forecast_date, {", ".join(cols)}
            FROM path p JOIN start s USING (symbol, scenario_id) GROUP BY 1, 2"""
    )


@register("horizon_summary", summary_sql())
def q_horizon_summary(spark, sf):
    s = G.path_summary(path_of(spark, sf), DAYS)
    out = []
    for c in s.columns:
        if c.endswith("_price") and c != "current_price":
            out.append(rr(c, 2))
        elif c.endswith("_return_pct"):
            out.append(rr(c, 6))
        else:
            out.append(F.col(c))
    return s.select(*out)


# --- S11, S15 ---------------------------------------------------------------------

@register(
    "forecast_sink",
    fsql("SELECT symbol, scenario_id, step, forecast_date, round(forecasted_close, 2) AS forecasted_close FROM path"),
)
def q_forecast_sink(spark, sf):
    """Write the forecast (parquet, partitioned by scenario) to the shared
    scratch folder and read it back."""
    from ..sources.sinks import write_forecast

    path = scratch_path(spark, f"forecast-{uuid.uuid4().hex}")
    write_forecast(path_of(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("symbol", "scenario_id", "step", "forecast_date", rr("forecasted_close", 2))


@register(
    "chart_series",
    fsql(
        f"""SELECT symbol, NULL::VARCHAR AS scenario_id, 'history' AS kind, bar_date AS point_date, round(close, 2) AS price
            FROM bars
            UNION ALL
            SELECT symbol, scenario_id, 'forecast' AS kind, forecast_date AS point_date, round(forecasted_close, 2) AS price
            FROM path"""
    ),
)
def q_chart_series(spark, sf):
    from ..operators.reports import chart_series

    return chart_series(orders_bars(spark, sf), path_of(spark, sf)).select(
        "symbol", "scenario_id", "kind", "point_date", rr("price", 2)
    )
