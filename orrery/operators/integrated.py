"""The posterior's own distribution on the grid, and a sweep over its parameters.

The normal approximation (D8, D11) ignores that the blended density is skewed and cut at the grid's end.
Here the density itself is integrated: a prefix trapezoid integral on the scenario's grid, read at
any year and inverted at any probability by interpolation inside the bracketing step.  All tables
are per scenario and bounded by the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.scenarios import GRID_POINTS, GRID_YEARS, GROWTH_SD_RATIO
from .arrival import KEY, growth_lognormal, survey_mixture

PERCENTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def integrated_distribution(grid: DataFrame, density: str = "combined") -> DataFrame:
    """``(scenario_id, i, x, cdf)``: the share of ``density``'s trapezoid integral up to each grid point."""
    w = Window.partitionBy(KEY).orderBy("i")
    step = (F.col("x") - F.lag("x").over(w)) * (F.col(density) + F.lag(density).over(w)) / 2.0
    g = grid.select(KEY, "i", "x", F.coalesce(step, F.lit(0.0)).alias("_step"))
    upto = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_step").over(Window.partitionBy(KEY))
    return g.select(KEY, "i", "x", (upto / total).alias("cdf"))


def _steps(dist: DataFrame) -> DataFrame:
    """Each grid step with the point before it."""
    w = Window.partitionBy(KEY).orderBy("i")
    return dist.select(KEY, "x", "cdf", F.lag("x").over(w).alias("x0"), F.lag("cdf").over(w).alias("cdf0")).where("x0 IS NOT NULL")


def integrated_quantiles(dist: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """``(scenario_id, percentile, year)``: where the distribution reaches each percentile (0 < p < 1), linear
    inside the step that brackets it; the first such step."""
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))
    found = _steps(dist).withColumn("percentile", wanted).where("cdf0 < percentile AND percentile <= cdf")
    share = (F.col("percentile") - F.col("cdf0")) / (F.col("cdf") - F.col("cdf0"))
    return found.select(KEY, "percentile", (F.col("x0") + share * (F.col("x") - F.col("x0"))).alias("year"))


def integrated_probabilities(dist: DataFrame, years: DataFrame) -> DataFrame:
    """``(scenario_id, year, cumulative_probability, yearly_probability)`` of the distribution itself for the
    ``(scenario_id, year)`` rows; 0 before the grid and 1 beyond it.

    Steps meet years through the whole years they touch, so a step is paired with those only."""
    steps = _steps(dist).withColumn("year", F.explode(F.sequence(F.ceil("x0").cast("int"), F.floor("x").cast("int"))))
    share = (F.col("year") - F.col("x0")) / (F.col("x") - F.col("x0"))
    # a year on a grid point ends one step and begins the next: both give the same value
    at = steps.where("x0 <= year AND year <= x").groupBy(KEY, "year").agg(F.min(F.col("cdf0") + share * (F.col("cdf") - F.col("cdf0"))).alias("_p"))
    ends = dist.groupBy(KEY).agg(F.min("x").alias("_first"))
    out = years.select(KEY, "year").join(at, [KEY, "year"], "left").join(ends, KEY)
    out = out.withColumn("cumulative_probability", F.coalesce("_p", F.when(F.col("year") < F.col("_first"), 0.0).otherwise(1.0)))
    before = F.lag("cumulative_probability").over(Window.partitionBy(KEY).orderBy("year"))
    return out.select(KEY, "year", "cumulative_probability",
                      (F.col("cumulative_probability") - F.coalesce(before, F.lit(0.0))).alias("yearly_probability"))


def parameter_sweep(surveys: DataFrame, params: DataFrame, weights, growth_factors, num: int = GRID_POINTS, span: int = GRID_YEARS,
                    sd_ratio: float = GROWTH_SD_RATIO) -> DataFrame:
    """Posterior mean and deviation for every survey weight and every factor on the scenario's yearly growth.

    ``(scenario_id, survey_weight, growth_factor, integral, posterior_mean, posterior_std)``.  The survey mixture
    is evaluated once per grid point; each grid point holds one growth density per factor as an array, and
    the trapezoid moments of the survey density and of each growth density are summed over the grid.  A
    blend is linear in the weight, so the whole sweep follows from those sums: rows per pair
    appear only in the result.
    """
    weights, factors = [float(w) for w in weights], [float(g) for g in growth_factors]
    mix = survey_mixture(surveys, params, num, span)
    p = params
    for k, factor in enumerate(factors):
        faster = growth_lognormal(params.withColumn("compute_growth_rate", F.col("compute_growth_rate") * factor), sd_ratio)
        p = p.join(faster.select(KEY, F.struct("shape", "log_scale").alias(f"_g{k}")), KEY)
    g = mix.join(p.select(KEY, "base_year", *[f"_g{k}" for k in range(len(factors))]), KEY)
    densities = F.array(F.col("survey_pdf"), *[stats.lognormal_pdf_shifted("x", "base_year", f"_g{k}.shape", f"_g{k}.log_scale") for k in range(len(factors))])
    h = span / (num - 1)
    # trapezoid weights of an even grid; moments about the base year, so that nothing cancels
    g = g.select(KEY, "base_year", (F.col("x") - F.col("base_year")).alias("_t"), densities.alias("_d"),
                 F.when(F.col("i").isin(0, num - 1), h / 2).otherwise(h).alias("_h"))
    sums = [F.sum(F.col("_h") * F.col("_d")[k] * power).alias(f"_m{k}_{n}") for k in range(len(factors) + 1)
            for n, power in enumerate((F.lit(1.0), F.col("_t"), F.col("_t") * F.col("_t")))]
    moments = g.groupBy(KEY, "base_year").agg(*sums)
    blends = []
    for w in weights:
        for k, factor in enumerate(factors):
            m0, m1, m2 = (F.lit(w) * F.col(f"_m0_{n}") + F.lit(1.0 - w) * F.col(f"_m{k + 1}_{n}") for n in range(3))
            mean = m1 / m0
            blends.append(F.struct(F.lit(w).alias("survey_weight"), F.lit(factor).alias("growth_factor"), m0.alias("integral"),
                                   (F.col("base_year") + mean).alias("posterior_mean"), F.sqrt(m2 / m0 - mean * mean).alias("posterior_std")))
    return moments.select(KEY, F.explode(F.array(*blends)).alias("_b")).select(KEY, "_b.*")
