"""Arrival-year distribution per scenario.

Shapes:

* surveys ``(scenario_id, source, median_year, ci_low, ci_high)`` — grows with data;
* params ``(scenario_id, base_year, compute_current, compute_agi_estimate,
  compute_growth_rate, expert_weight, growth_weight)`` — one row per scenario;
* grid ``(scenario_id, i, x, ...)`` — exactly 1000 rows per scenario;
* years ``(scenario_id, year, ...)`` — a few dozen rows per scenario.

The survey mixture explodes the 1000 grid points next to each survey
component and aggregates at once by ``(scenario_id, i)``; partial aggregation
keeps the shuffle at one row per task and grid point, however many components
a scenario has.  Everything after that works on per-scenario tables whose size
is fixed by the grid or the year list, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.scenarios import (
    DISCOUNT_RATE, GRID_POINTS, GRID_YEARS, GROWTH_SD_RATIO, IMPACT_DURATION, IMPACT_LAG, IMPACT_THRESHOLD,
)
from ..sources.spines import linspace_grid, year_spine

KEY = "scenario_id"


def _w_grid():
    return Window.partitionBy(KEY).orderBy("i")


def _w_all():
    return Window.partitionBy(KEY)


def _w_year():
    return Window.partitionBy(KEY).orderBy("year")


def survey_components(surveys: DataFrame) -> DataFrame:
    """Add ``sigma`` = (ci_high - ci_low) / (2 * 1.96) to each survey."""
    return surveys.withColumn("sigma", stats.ci_to_sigma("ci_low", "ci_high"))


def grid_cross_components(surveys: DataFrame, params: DataFrame, num: int = GRID_POINTS,
                          span: int = GRID_YEARS) -> DataFrame:
    """J3 + D2: every grid point of the scenario next to every component, with
    the component's normal density at that point."""
    comps = survey_components(surveys).join(params.select(KEY, "base_year"), KEY)
    g = linspace_grid(comps, "base_year", span, num)
    return g.withColumn("pdf", stats.normal_pdf("x", "median_year", "sigma"))


def survey_mixture(surveys: DataFrame, params: DataFrame, num: int = GRID_POINTS,
                   span: int = GRID_YEARS) -> DataFrame:
    """D3 / A1: equal-weight normal mixture on the grid ``(scenario_id, i, x, survey_pdf)``.

    Components with the same (median, sigma) have the same density, so they
    are counted first and each distinct one is evaluated once on the grid
    with its count as weight: the grid work scales with the distinct
    intervals per scenario (a few hundred), not with the number of surveys.
    """
    comps = survey_components(surveys).groupBy(KEY, "median_year", "sigma").agg(F.count(F.lit(1)).alias("_w"))
    comps = comps.join(params.select(KEY, "base_year"), KEY)
    g = linspace_grid(comps, "base_year", span, num)
    g = g.withColumn("pdf", stats.normal_pdf("x", "median_year", "sigma"))
    return g.groupBy(KEY, "i", "x").agg((F.sum(F.col("pdf") * F.col("_w")) / F.sum("_w")).alias("survey_pdf"))


def growth_lognormal(params: DataFrame, sd_ratio: float = GROWTH_SD_RATIO) -> DataFrame:
    """Years to the compute target and the matching lognormal parameters.

    mean = ln(target / current) / ln(growth); sd = 0.3 * mean;
    shape = sqrt(ln(1 + (sd / mean)^2)); log_scale = ln(mean) - shape^2 / 2.
    """
    mean = F.log(F.col("compute_agi_estimate") / F.col("compute_current")) / F.log("compute_growth_rate")
    p = params.withColumn("mean_years", mean).withColumn("std_years", F.col("mean_years") * sd_ratio)
    ratio = F.col("std_years") / F.col("mean_years")
    p = p.withColumn("shape", F.sqrt(F.log(1 + ratio * ratio)))
    return p.withColumn("log_scale", F.log("mean_years") - F.col("shape") * F.col("shape") * 0.5)


def density_grid(surveys: DataFrame, params: DataFrame, num: int = GRID_POINTS, span: int = GRID_YEARS) -> DataFrame:
    """D5 + D6 / J4: survey and growth densities side by side on the grid, and
    their blend ``combined = expert_weight * survey + growth_weight * growth``."""
    mix = survey_mixture(surveys, params, num, span)
    g = growth_lognormal(params).select(KEY, "base_year", "shape", "log_scale", "expert_weight", "growth_weight")
    out = mix.join(g, KEY)
    out = out.withColumn("growth_pdf", stats.lognormal_pdf_shifted("x", "base_year", "shape", "log_scale"))
    out = out.withColumn(
        "combined", F.col("expert_weight") * F.col("survey_pdf") + F.col("growth_weight") * F.col("growth_pdf")
    )
    return out.select(KEY, "i", "x", "survey_pdf", "growth_pdf", "combined")


def _trapezoid_segments(df: DataFrame, y: str, out: str) -> DataFrame:
    """Segment areas (x_i - x_(i-1)) * (y_i + y_(i-1)) / 2 along the grid."""
    return df.withColumn(
        out, (F.col("x") - F.lag("x").over(_w_grid())) * (F.col(y) + F.lag(y).over(_w_grid())) / 2.0
    )


def trapezoid_integral(grid: DataFrame, y: str = "combined", out: str = "integral") -> DataFrame:
    """A2: per-scenario trapezoid integral of ``y`` over ``x``."""
    segs = _trapezoid_segments(grid, y, "_seg")
    return segs.groupBy(KEY).agg(F.sum("_seg").alias(out))


def posterior_grid(grid: DataFrame) -> DataFrame:
    """D7 on the grid: A3 normalised ``density``, A4 ``posterior_mean``, A5
    ``posterior_std`` (all as window sums over the scenario's 1000 points)."""
    g = _trapezoid_segments(grid, "combined", "_s0").withColumn("integral", F.sum("_s0").over(_w_all()))
    g = g.withColumn("density", F.col("combined") / F.col("integral"))
    g = g.withColumn("_xp", F.col("x") * F.col("density"))
    g = _trapezoid_segments(g, "_xp", "_s1").withColumn("posterior_mean", F.sum("_s1").over(_w_all()))
    dev = F.col("x") - F.col("posterior_mean")
    g = g.withColumn("_vp", dev * dev * F.col("density"))
    g = _trapezoid_segments(g, "_vp", "_s2").withColumn("posterior_std", F.sqrt(F.sum("_s2").over(_w_all())))
    return g.drop("_s0", "_s1", "_s2", "_xp", "_vp")


def posterior_moments(surveys: DataFrame, params: DataFrame) -> DataFrame:
    """``(scenario_id, base_year, integral, posterior_mean, posterior_std)``."""
    g = posterior_grid(density_grid(surveys, params))
    post = g.groupBy(KEY).agg(
        F.first("integral").alias("integral"),
        F.first("posterior_mean").alias("posterior_mean"),
        F.first("posterior_std").alias("posterior_std"),
    )
    return post.join(params.select(KEY, "base_year"), KEY)


def with_cumulative(df: DataFrame, year: str = "year", out: str = "cumulative_probability") -> DataFrame:
    """Normal-approximation CDF at ``year`` from the posterior moments."""
    df = df.withColumn("_z", (F.col(year) - F.col("posterior_mean")) / F.col("posterior_std"))
    return df.withColumn(out, stats.normal_cdf("_z")).drop("_z")


def year_probabilities(post: DataFrame, start_offset: int = 0, n_years: int = 40, step: int = 1) -> DataFrame:
    """``(scenario_id, year, cumulative_probability, yearly_probability)`` for
    ``base_year + start_offset ... + n_years`` (exclusive); the first year's
    yearly probability is its cumulative one."""
    y = year_spine(post, F.col("base_year") + start_offset, F.col("base_year") + start_offset + n_years, step)
    y = with_cumulative(y)
    y = y.withColumn(
        "yearly_probability",
        F.coalesce(F.col("cumulative_probability") - F.lag("cumulative_probability").over(_w_year()),
                   F.col("cumulative_probability")),
    )
    return y.select(KEY, "year", "cumulative_probability", "yearly_probability")


def forward_range_join(yp: DataFrame, duration: int = IMPACT_DURATION) -> DataFrame:
    """Each year with the supplied later years in ``(year, year + duration]``.

    The range is expanded to the ``duration`` candidate years and matched with
    an equi join on ``(scenario_id, year)``, so no pair outside the range is
    ever formed.
    """
    cand = yp.select(KEY, "year", F.explode(F.sequence(F.lit(1), F.lit(duration))).alias("_ahead")).withColumn(
        "future_year", F.col("year") + F.col("_ahead")
    )
    fut = yp.select(KEY, F.col("year").alias("future_year"), F.col("yearly_probability").alias("future_yearly"))
    out = cand.join(fut, [KEY, "future_year"])
    return out.select(
        KEY, "year", "future_year", "future_yearly",
        (1 - (F.col("future_year") - F.col("year")) / F.lit(float(duration))).alias("weight"),
    )


def proximity_weighted_sum(yp: DataFrame, duration: int = IMPACT_DURATION) -> DataFrame:
    """Sum of later yearly probabilities weighted by ``1 - (y - year) / duration``
    over the supplied years in ``(year, year + duration]``; 0 when there are none.

    A RANGE frame of at most ``duration`` rows per year: no join, and no
    expansion of the weight (which would cancel badly on raw years).
    """
    frame = _w_year().rangeBetween(1, duration)
    later = F.collect_list(F.struct("year", "yearly_probability")).over(frame)
    total = F.aggregate(
        later, F.lit(0.0),
        lambda acc, e: acc + e["yearly_probability"] * (1 - (e["year"] - F.col("year")) / F.lit(float(duration))),
    )
    return yp.withColumn("weighted_future", total)


def impact_factor(yp: DataFrame, duration: int = IMPACT_DURATION, lag: int = IMPACT_LAG,
                  threshold: float = IMPACT_THRESHOLD, rate: float = DISCOUNT_RATE) -> DataFrame:
    """``(cumulative * threshold + weighted future) / (1 + rate)^lag``.

    Only the supplied years take part (a three-year list gives other factors
    than a twenty-year list, as in the reference).  The lag only discounts.
    """
    discount = 1 / (1 + rate) ** lag
    w = proximity_weighted_sum(yp, duration)
    return w.select(
        KEY, "year",
        F.col("cumulative_probability").alias("agi_probability"),
        ((F.col("cumulative_probability") * threshold + F.col("weighted_future")) * F.lit(discount)).alias(
            "stock_impact_factor"
        ),
    )


def percentile_years(post: DataFrame) -> DataFrame:
    """Posterior-normal quantiles at 10/25/50/75/90 %."""
    pts = F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(z).alias("z")) for p, z in stats.PERCENTILE_Z.items()])
    out = post.select(KEY, "posterior_mean", "posterior_std", F.explode(pts).alias("_p"))
    return out.select(
        KEY, F.col("_p.percentile").alias("percentile"),
        (F.col("posterior_mean") + F.col("posterior_std") * F.col("_p.z")).alias("year"),
    )


THRESHOLDS = (0.1, 0.25, 0.5, 0.75, 0.9)


def nearest_threshold_year(curve: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Year whose cumulative probability is closest to each threshold
    (the earliest on ties)."""
    t = curve.select("*", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    gap = F.abs(F.col("cumulative_probability") - F.col("threshold"))
    return t.groupBy(KEY, "threshold").agg(F.min_by("year", F.struct(gap, F.col("year"))).alias("year"))


def first_crossing_year(curve: DataFrame, thresholds=(0.1, 0.5)) -> DataFrame:
    """First year with cumulative probability >= threshold (NULL if none)."""
    t = curve.select("*", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    return t.groupBy(KEY, "threshold").agg(
        F.min(F.when(F.col("cumulative_probability") >= F.col("threshold"), F.col("year"))).alias("year")
    )


def horizon_probability(post: DataFrame, horizon: int = 5, list_years: int = 15) -> DataFrame:
    """Cumulative probability at base year + ``horizon``, looked up in the
    ``base_year ... base_year + list_years`` table (P5)."""
    yp = year_probabilities(post, 0, list_years)
    b = post.select(KEY, (F.col("base_year") + horizon).alias("year"))
    return b.join(yp, [KEY, "year"]).select(KEY, "year", F.col("cumulative_probability").alias("agi_probability"))


def stride_probabilities(post: DataFrame, base_year: int, span: int = 30, stride: int = 5) -> DataFrame:
    """Cumulative probability every ``stride`` years for ``span`` years, one
    column ``agi_prob_<year>`` each (a pivot over a fixed list of years)."""
    years = list(range(base_year, base_year + span, stride))
    yp = year_probabilities(post, 0, span, stride)
    return (
        yp.withColumn("name", F.concat(F.lit("agi_prob_"), F.col("year").cast("string")))
        .groupBy(KEY)
        .pivot("name", [f"agi_prob_{y}" for y in years])
        .agg(F.first("cumulative_probability"))
    )


def density_curves(surveys: DataFrame, params: DataFrame) -> DataFrame:
    """Survey, growth and posterior-normal densities on the grid."""
    g = posterior_grid(density_grid(surveys, params))
    return g.select(
        KEY, "i", "x", "survey_pdf", "growth_pdf",
        stats.normal_pdf("x", "posterior_mean", "posterior_std").alias("posterior_pdf"),
    )


def year_panel(post: DataFrame, n_years: int = 20) -> DataFrame:
    """Probabilities and impact factors side by side for ``n_years`` years."""
    yp = year_probabilities(post, 0, n_years)
    imp = impact_factor(yp).select(KEY, "year", "stock_impact_factor")
    return yp.join(imp, [KEY, "year"])
