"""Forecast operators G1-G6 and the year join with fallback.

A forecast runs for every (symbol, scenario_id) pair of a *plan* table.  The
path is the reference's day loop in closed form: steps 0-29 stay at the last
close; from step 30 on, step k compounds by ``(1 + r_b)^(1/30)`` with
``b = k div 30`` and ``r_b = predicted_return * (1 + impact factor of the
year of step 30b)``, so

    price(s) = last_close * exp( sum_{k=30..s} ln(1 + r_(k div 30)) / 30 ).

That running sum is one window per path, whose length is the forecast horizon
(not the data size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spines import calendar_spine
from . import arrival as A

BLOCK_DAYS = 30
BAND_WIDTH = 0.2  # fixed value: +-20 % per sqrt(year) band of the reference
BAND_YEAR_DAYS = 252
MILESTONE_DAYS = (90, 180, 365)
HORIZONS = {"1_month": 30, "3_months": 90, "6_months": 180, "1_year": 365}


def latest_row(df: DataFrame, key: str = "symbol", order: str = "bar_date") -> DataFrame:
    """G1: the last row of every series (``max_by`` over the order column; a
    grouped aggregate with map-side partial results, no window)."""
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return agg.select(key, *[F.col(f"_last.{c}").alias(c) for c in others])


def mean_target_prediction(target: DataFrame) -> DataFrame:
    """A deterministic stand-in prediction per symbol: the geometric mean of its
    historical 30-row returns, ``exp(avg(ln(1 + r))) - 1`` (used where results
    must not depend on the forest; an arithmetic mean of noisy price ratios
    would compound absurdly)."""
    t = F.col("target_30d_return")
    return target.filter(t > -1).groupBy("symbol").agg(
        (F.exp(F.avg(F.log(1 + t))) - 1).alias("predicted_return")
    )


def forecast_years(base_year: int, days: int) -> tuple[int, int]:
    """The impact years the reference supplies: ``[base, base + days // 365 + 2)``."""
    return base_year, base_year + days // 365 + 2


def impact_with_fallback(impact: DataFrame) -> DataFrame:
    """The last supplied year per scenario (J1's fallback row)."""
    return impact.groupBy(A.KEY).agg(
        F.max_by(F.struct("stock_impact_factor", "agi_probability"), F.col("year")).alias("_last")
    ).select(
        A.KEY,
        F.col("_last.stock_impact_factor").alias("fallback_factor"),
        F.col("_last.agi_probability").alias("fallback_probability"),
    )


def year_join_with_fallback(rows: DataFrame, impact: DataFrame, year_col: str = "block_year") -> DataFrame:
    """Attach the impact row of ``year_col``; when the year is not supplied
    (earlier or later) use the scenario's last supplied year."""
    imp = impact.select(A.KEY, F.col("year").alias(year_col), "stock_impact_factor", "agi_probability")
    out = rows.join(imp, [A.KEY, year_col], "left").join(impact_with_fallback(impact), A.KEY, "left")
    return out.withColumn(
        "impact_factor", F.coalesce("stock_impact_factor", "fallback_factor")
    ).withColumn(
        "block_agi_probability", F.coalesce("agi_probability", "fallback_probability")
    ).drop("stock_impact_factor", "agi_probability", "fallback_factor", "fallback_probability")


def forecast_path(start: DataFrame, impact: DataFrame, days: int = 365) -> DataFrame:
    """G2 + G3 (+ S8, J1, W8): day-by-day forecast per (symbol, scenario_id).

    ``start`` has ``symbol, scenario_id, bar_date`` (last bar), ``close`` (last
    close) and ``predicted_return``; ``impact`` is D10's table per scenario.
    Output: ``symbol, scenario_id, step, forecast_date, block, adjusted_return,
    forecasted_close``, and the path's ``last_close`` and ``last_date``, so that what follows needs no
    second look at ``start``.
    """
    steps = calendar_spine(start, days)
    steps = steps.withColumn("block", F.expr(f"cast(step div {BLOCK_DAYS} as int)")).withColumn(
        "block_year", F.year(F.date_add("bar_date", 1 + BLOCK_DAYS * F.col("block")))
    )
    steps = year_join_with_fallback(steps, impact)
    steps = steps.withColumn("adjusted_return", F.col("predicted_return") * (1 + F.col("impact_factor")))
    compounding = F.col("block") >= 1
    valid = 1 + F.col("adjusted_return") > 0
    growth = F.when(compounding & valid, F.log(1 + F.col("adjusted_return")) / BLOCK_DAYS).otherwise(F.lit(0.0))
    # a factor (1 + r)^(1/30) with 1 + r <= 0 has no value: the path is NULL from there on
    broken = F.when(compounding & ~valid, 1).otherwise(0)
    w = Window.partitionBy("symbol", A.KEY).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn(
        "forecasted_close",
        F.when(F.sum(broken).over(w) == 0, F.col("close") * F.exp(F.sum(growth).over(w))),
    )
    return steps.select(
        "symbol", A.KEY, "step", "forecast_date", "block",
        F.when(F.col("block") >= 1, F.col("adjusted_return")).alias("adjusted_return"),
        "forecasted_close", F.col("close").alias("last_close"), F.col("bar_date").alias("last_date"),
    )


def uncertainty_band(path: DataFrame, width: float = BAND_WIDTH) -> DataFrame:
    """Forecast * (1 +- width * sqrt(step / 252))."""
    spread = F.lit(width) * F.sqrt(F.col("step") / F.lit(float(BAND_YEAR_DAYS)))
    return path.withColumn("upper_bound", F.col("forecasted_close") * (1 + spread)).withColumn(
        "lower_bound", F.col("forecasted_close") * (1 - spread)
    )


def milestones(path: DataFrame, days: int, steps=MILESTONE_DAYS) -> DataFrame:
    """Price at 0-based steps 90, 180, 365 when the step exists, labelled ``Mon YYYY``."""
    keep = [s for s in steps if s < days]
    return path.filter(F.col("step").isin(keep)).select(
        "symbol", A.KEY, "step", "forecast_date",
        F.date_format("forecast_date", "MMM yyyy").alias("label"), "forecasted_close",
    )


def path_summary(path: DataFrame, days: int, horizons: dict = HORIZONS) -> DataFrame:
    """Price at step d-1 and % return against the last actual close for each
    horizon d with ``d < days`` (so a 365-day forecast has NULL 1-year columns,
    as in the reference); conditional aggregation, one row per path."""
    aggs = [F.max("last_close").alias("current_price"), F.date_add(F.max("last_date"), 1).alias("forecast_date")]
    for label, d in horizons.items():
        price = F.max(F.when(F.col("step") == d - 1, F.col("forecasted_close"))) if d < days else F.lit(None).cast("double")
        aggs.append(price.alias(f"{label}_price"))
    out = path.groupBy("symbol", A.KEY).agg(*aggs)
    for label in horizons:
        out = out.withColumn(f"{label}_return_pct", (F.col(f"{label}_price") / F.col("current_price") - 1) * 100)
    return out.select("symbol", A.KEY, "current_price", "forecast_date",
                      *[c for label in horizons for c in (f"{label}_price", f"{label}_return_pct")])


def horizon_summary(path: DataFrame, start: DataFrame, days: int, horizons: dict = HORIZONS) -> DataFrame:
    """G6 for any path table: the last close and date come from ``start``, one row per path."""
    last = start.select("symbol", A.KEY, F.col("close").alias("last_close"), F.col("bar_date").alias("last_date"))
    return path_summary(path.drop("last_close", "last_date").join(last, ["symbol", A.KEY]), days, horizons)
