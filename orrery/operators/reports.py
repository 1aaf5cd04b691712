"""Report-shaped operators: tail rows (O3), chart series (S15), report metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bars_tail(bars: DataFrame, n: int = 5, key: str = "symbol", order: str = "bar_date") -> DataFrame:
    """O3: the last ``n`` rows of every series.

    ``row_number() <= n`` over a descending order is planned by Spark as a
    window group limit: each task keeps only its top ``n`` per key before the
    shuffle, so a hot key never moves more than ``n`` rows per task.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return bars.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def chart_series(bars: DataFrame, path: DataFrame) -> DataFrame:
    """History and forecast on one axis ``(symbol, scenario_id, kind,
    point_date, price)``; history rows carry no scenario."""
    hist = bars.select(
        "symbol", F.lit(None).cast("string").alias("scenario_id"), F.lit("history").alias("kind"),
        F.col("bar_date").alias("point_date"), F.col("close").alias("price"),
    )
    fc = path.select(
        "symbol", "scenario_id", F.lit("forecast").alias("kind"),
        F.col("forecast_date").alias("point_date"), F.col("forecasted_close").alias("price"),
    )
    return hist.unionByName(fc)


def report_metrics(summary: DataFrame, post: DataFrame, years=(2030, 2035, 2040, 2050)) -> DataFrame:
    """The report's cards as a long table ``(symbol, scenario_id, metric,
    value)``: current price, 1/3-month and 1-year forecast, and the normal-CDF
    probability by fixed years (computed at those years, not looked up in the
    5-year strides, so a base year off the stride grid still reports them)."""
    from .arrival import with_cumulative

    none = F.lit(None)
    cards = [F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("price"), none.cast("int").alias("year"))
             for name in ("current_price", "1_month_price", "3_months_price", "1_year_price")]
    cards += [F.struct(F.lit(f"agi_prob_{v}").alias("metric"), none.cast("double").alias("price"), F.lit(v).alias("year")) for v in years]
    # one row per card from one read of the summary; a scenario without a posterior has its prices only
    known = summary.join(post.select("scenario_id", "posterior_mean", "posterior_std"), "scenario_id", "left")
    rows = with_cumulative(known.select("symbol", "scenario_id", "posterior_mean", "posterior_std", F.inline(F.array(*cards))))
    return rows.where("year IS NULL OR posterior_mean IS NOT NULL").select(
        "symbol", "scenario_id", "metric", F.when(F.col("year").isNull(), F.col("price")).otherwise(F.col("cumulative_probability")).alias("value"))
