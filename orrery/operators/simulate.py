"""Seeded Monte Carlo price paths with mergeable quantiles per step.

A path's daily log return is the forecast's deterministic growth plus the symbol's volatility times a
normal draw.  The draw comes from a hash of (seed, symbol, scenario, path, step) by Box and Muller, so a
result depends on the seed alone: not on partitions, order or retries.  Paths are dealt by their
name before their steps are made, so the running sums need no further shuffle; what is shuffled then
are counts per step and bin.

Quantiles come from logarithmic bins: bin b holds prices in (G^(b-1), G^b], and is answered by the
value whose relative distance to both ends is the same.  Counts add up, so sketches of any partitioning
merge to the same one; a quantile is within ``RELATIVE_ERROR`` of the exact one (the smallest value
with at least q of all paths at or below it), and a step has few bins however many paths there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sequence import Series, over_series
from .arrival import KEY

RELATIVE_ERROR = 0.005
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def uniform(digest: Column, at: int) -> Column:
    """A number inside (0, 1) from 13 of the 32 hex digits of a digest, as a multiple of 2^-52 and half a step."""
    return (F.conv(F.substring(digest, at, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def normal_draw(*name: Column, seed: int) -> Column:
    """A standard normal number from a hash of the name."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in name]))
    return F.sqrt(-2 * F.log(uniform(digest, 1))) * F.cos(F.lit(2 * math.pi) * uniform(digest, 14))


def daily_volatility(bars: DataFrame, series: Series = Series()) -> DataFrame:
    """``(symbol, volatility)``: the sample deviation of daily log returns, over the block layout."""
    out = over_series(bars, lambda d, s: d.withColumn("_r", F.log(F.col("close") / F.lag("close").over(s.w))), series, back=1, ahead=0)
    return out.groupBy(series.key).agg(F.stddev_samp("_r").alias("volatility"))


def simulate_paths(path: DataFrame, volatility: DataFrame, n_paths: int, seed: int) -> DataFrame:
    """``(symbol, scenario_id, path, step, price)`` for every forecast step of every path.

    ``path`` is the deterministic forecast (``forecasted_close`` per step, and ``last_close``).  Symbols without
    a volatility have no paths."""
    w = Window.partitionBy("symbol", KEY).orderBy("step")
    # the forecast's steps as one array per (symbol, scenario): as long as the horizon
    growth = F.log(F.col("forecasted_close") / F.coalesce(F.lag("forecasted_close").over(w), F.col("last_close")))
    drift = path.withColumn("growth", growth).where("growth IS NOT NULL").groupBy("symbol", KEY, F.col("last_close").alias("close")).agg(F.sort_array(F.collect_list(F.struct("step", "growth"))).alias("steps"))
    names = drift.join(volatility.where("volatility IS NOT NULL"), "symbol").withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    steps = names.repartition("symbol", KEY, "path").select("symbol", KEY, "path", "close", "volatility", F.inline("steps"))
    z = normal_draw(F.col("symbol"), F.col(KEY), F.col("path"), F.col("step"), seed=seed)
    upto = Window.partitionBy("symbol", KEY, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    moved = steps.withColumn("_r", F.col("growth") + F.col("volatility") * z)
    return moved.select("symbol", KEY, "path", "step", (F.col("close") * F.exp(F.sum("_r").over(upto))).alias("price"))


def gamma(relative_error: float = RELATIVE_ERROR) -> float:
    return (1 + relative_error) / (1 - relative_error)


def quantile_sketch(values: DataFrame, keys: list[str], value: str, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """``(*keys, bin, n)``: how many positive values lie in each logarithmic bin; counted map-side first."""
    bin_ = F.ceil(F.log(value) / F.lit(math.log(gamma(relative_error)))).cast("int")
    return values.where(F.col(value) > 0).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], quantiles=QUANTILES, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """``(*keys, quantile, value)`` of each sketch."""
    g = gamma(relative_error)
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    c = sketch.select(*keys, "bin", "n", upto.alias("_upto"), F.sum("n").over(w).alias("_all"))
    c = c.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.greatest(F.ceil(F.col("quantile") * F.col("_all") - 1e-9), F.lit(1))
    hit = c.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank))
    return hit.select(*keys, "quantile", (F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bin"))).alias("value"))
