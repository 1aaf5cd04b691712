"""Registered queries: arrival-year distribution and impact factors per scenario.

Scenarios come from ``lineitem``: one per return flag, one survey component
per (return flag, supplier), see :mod:`orrery.sources.scenarios`.  Base year
2025 for every scenario.  Rounding: densities 9 places, years / moments /
probabilities / factors 6 places.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import arrival as A
from ..sources import scenarios as SC
from ..sources.spines import linspace_grid, year_spine
from .common import dbl, register, table

BASE_YEAR = 2025
N = SC.GRID_POINTS
SPAN = SC.GRID_YEARS


def inputs(spark, sf):
    li = table(spark, sf, "lineitem")
    return SC.scenario_inputs(li, BASE_YEAR)


def post_of(spark, sf):
    return A.posterior_moments(*inputs(spark, sf))


def r(col, p):
    return F.round(col, p).alias(col if isinstance(col, str) else None)


def rr(name, p):
    return F.round(F.col(name), p).alias(name)


# --- DuckDB oracle chain ------------------------------------------------------

SQRT2PI = dbl(math.sqrt(2 * math.pi))

def chain_sql(base_year: int = BASE_YEAR) -> str:
    """The DuckDB CTE chain from lineitem to the posterior moments (``post``)."""
    return f"""
params AS (
  SELECT l_returnflag AS scenario_id, {base_year} AS base_year, {dbl(SC.COMPUTE_CURRENT)} AS compute_current,
         {dbl(SC.COMPUTE_TARGET)} AS compute_agi_estimate,
         {dbl(1.25)} + {dbl(0.1)} * avg(CASE WHEN l_linestatus = 'F' THEN {dbl(1)} ELSE {dbl(0)} END) AS compute_growth_rate,
         {dbl(0.5)} AS expert_weight, {dbl(0.5)} AS growth_weight
  FROM lineitem GROUP BY 1
),
surveys AS (
  SELECT * FROM (
    SELECT l_returnflag AS scenario_id, 'supp-' || CAST(l_suppkey AS VARCHAR) AS source,
           CAST(2020 + floor(avg(l_quantity)) AS INTEGER) AS median_year,
           CAST(2020 + floor(avg(l_quantity)) - floor(stddev_samp(l_quantity)) AS INTEGER) AS ci_low,
           CAST(2020 + floor(avg(l_quantity)) + floor(stddev_samp(l_quantity) * 1.5) AS INTEGER) AS ci_high
    FROM lineitem GROUP BY 1, 2) WHERE ci_high > ci_low
),
comps AS (SELECT *, (ci_high - ci_low) / {dbl(2 * 1.96)} AS sigma FROM surveys),
cgrid AS (
  SELECT c.scenario_id, c.source, c.median_year, c.sigma, CAST(g.i AS INTEGER) AS i,
         CASE WHEN g.i = {N - 1} THEN CAST(p.base_year + {SPAN} AS DOUBLE)
              ELSE g.i * {dbl(SPAN / (N - 1))} + p.base_year END AS x
  FROM comps c JOIN params p USING (scenario_id) CROSS JOIN range({N}) g(i)
),
cpdf AS (
  SELECT *, exp(-(((x - median_year) / sigma) * ((x - median_year) / sigma)) / {dbl(2)}) / {SQRT2PI} / sigma AS pdf
  FROM cgrid
),
mix AS (SELECT scenario_id, i, x, avg(pdf) AS survey_pdf FROM cpdf GROUP BY 1, 2, 3),
growth AS (
  SELECT *, ln(mean_years) - shape * shape * {dbl(0.5)} AS log_scale FROM (
    SELECT *, sqrt(ln(1 + (std_years / mean_years) * (std_years / mean_years))) AS shape FROM (
      SELECT *, mean_years * {dbl(SC.GROWTH_SD_RATIO)} AS std_years FROM (
        SELECT *, ln(compute_agi_estimate / compute_current) / ln(compute_growth_rate) AS mean_years FROM params)))
),
dgrid AS (
  SELECT m.scenario_id, m.i, m.x, m.survey_pdf,
         CASE WHEN m.x - g.base_year > 0 THEN
           exp(-(ln((m.x - g.base_year) / exp(g.log_scale)) * ln((m.x - g.base_year) / exp(g.log_scale)))
               / (g.shape * g.shape * {dbl(2)}))
           / (g.shape * ((m.x - g.base_year) / exp(g.log_scale)) * {SQRT2PI}) / exp(g.log_scale)
         ELSE {dbl(0)} END AS growth_pdf,
         g.expert_weight, g.growth_weight
  FROM mix m JOIN growth g USING (scenario_id)
),
dgrid2 AS (SELECT scenario_id, i, x, survey_pdf, growth_pdf,
                  expert_weight * survey_pdf + growth_weight * growth_pdf AS combined FROM dgrid),
p0 AS (SELECT *, (x - lag(x) OVER w) * (combined + lag(combined) OVER w) / 2 AS s0
       FROM dgrid2 WINDOW w AS (PARTITION BY scenario_id ORDER BY i)),
p1 AS (SELECT *, combined / sum(s0) OVER (PARTITION BY scenario_id) AS density,
              sum(s0) OVER (PARTITION BY scenario_id) AS integral FROM p0),
p2 AS (SELECT *, (x - lag(x) OVER w) * (x * density + lag(x * density) OVER w) / 2 AS s1
       FROM p1 WINDOW w AS (PARTITION BY scenario_id ORDER BY i)),
p3 AS (SELECT *, sum(s1) OVER (PARTITION BY scenario_id) AS posterior_mean FROM p2),
p4 AS (SELECT *, (x - lag(x) OVER w) * ((x - posterior_mean) * (x - posterior_mean) * density
              + lag((x - posterior_mean) * (x - posterior_mean) * density) OVER w) / 2 AS s2
       FROM p3 WINDOW w AS (PARTITION BY scenario_id ORDER BY i)),
pgrid AS (SELECT *, sqrt(sum(s2) OVER (PARTITION BY scenario_id)) AS posterior_std FROM p4),
post AS (
  SELECT DISTINCT g.scenario_id, g.integral, g.posterior_mean, g.posterior_std, p.base_year
  FROM pgrid g JOIN params p USING (scenario_id)
)"""


def years_cte(name: str, start_off: int, n: int, step: int = 1) -> str:
    """A year-probability CTE over ``base_year + start_off ... + n`` (exclusive)."""
    cdf = stats.normal_cdf_sql("z")
    return f""",
{name} AS (
  SELECT scenario_id, year, cumulative_probability,
         coalesce(cumulative_probability - lag(cumulative_probability) OVER (PARTITION BY scenario_id ORDER BY year),
                  cumulative_probability) AS yearly_probability
  FROM (SELECT scenario_id, year, {cdf} AS cumulative_probability FROM (
          SELECT scenario_id, year, (year - posterior_mean) / posterior_std AS z FROM (
            SELECT scenario_id, posterior_mean, posterior_std,
                   CAST(unnest(range(base_year + {start_off}, base_year + {start_off + n}, {step})) AS INTEGER) AS year
            FROM post)))
)"""


def impact_cte(name: str, years: str, duration: int = SC.IMPACT_DURATION) -> str:
    discount = 1 / (1 + SC.DISCOUNT_RATE) ** SC.IMPACT_LAG
    return f""",
{name} AS (
  SELECT a.scenario_id, a.year, a.cumulative_probability AS agi_probability,
         (a.cumulative_probability * {dbl(SC.IMPACT_THRESHOLD)} + coalesce(f.weighted_future, 0)) * {dbl(discount)}
           AS stock_impact_factor
  FROM {years} a LEFT JOIN (
    SELECT a.scenario_id, a.year,
           sum(b.yearly_probability * (1 - (b.year - a.year) / {dbl(duration)})) AS weighted_future
    FROM {years} a JOIN {years} b ON a.scenario_id = b.scenario_id AND b.year > a.year AND b.year <= a.year + {duration}
    GROUP BY 1, 2) f USING (scenario_id, year)
)"""


CHAIN = chain_sql(BASE_YEAR)


def sql(final: str, extra: str = "") -> str:
    return f"WITH {CHAIN}{extra}\n{final}"


# --- S6, S7, S9, S10 ------------------------------------------------------------

@register("survey_scan", sql("SELECT * FROM surveys"))
def q_survey_scan(spark, sf):
    return inputs(spark, sf)[0]


@register(
    "growth_params_scan",
    sql(f"""SELECT scenario_id, compute_current, compute_agi_estimate, round(compute_growth_rate, 9) AS compute_growth_rate,
                   {dbl(SC.PARAMETER_SCALING_EXPONENT)} AS parameter_scaling_exponent,
                   {dbl(SC.DATA_SCALING_EXPONENT)} AS data_scaling_exponent,
                   {SC.EFFECTIVE_HORIZON} AS effective_horizon FROM params"""),
)
def q_growth_params_scan(spark, sf):
    t = SC.growth_params_table(inputs(spark, sf)[1])
    return t.withColumn("compute_growth_rate", F.round("compute_growth_rate", 9))


SPINES = {"horizon15": (0, 15, 1), "panel20": (0, 20, 1), "curve40": (0, 40, 1), "forecast3": (0, 3, 1), "stride5": (0, 30, 5)}


@register(
    "year_spine",
    sql(
        " UNION ALL ".join(
            f"SELECT scenario_id, '{k}' AS spine, CAST(unnest(range(base_year + {a}, base_year + {a + n}, {s})) AS INTEGER) AS year FROM params"
            for k, (a, n, s) in SPINES.items()
        )
    ),
)
def q_year_spine(spark, sf):
    params = inputs(spark, sf)[1]
    out = None
    for k, (a, n, s) in SPINES.items():
        y = year_spine(params, F.col("base_year") + a, F.col("base_year") + a + n, s).select(
            "scenario_id", F.lit(k).alias("spine"), "year"
        )
        out = y if out is None else out.unionByName(y)
    return out


@register(
    "linspace_grid",
    sql(f"""SELECT scenario_id, CAST(g.i AS INTEGER) AS i,
                   round(CASE WHEN g.i = {N - 1} THEN CAST(base_year + {SPAN} AS DOUBLE)
                              ELSE g.i * {dbl(SPAN / (N - 1))} + base_year END, 9) AS x
            FROM params CROSS JOIN range({N}) g(i)"""),
)
def q_linspace_grid(spark, sf):
    g = linspace_grid(inputs(spark, sf)[1], "base_year", SPAN, N)
    return g.select("scenario_id", "i", rr("x", 9))


# --- D1-D7, A1-A5, J3, J4 --------------------------------------------------------

@register("ci_to_sigma", sql("SELECT scenario_id, source, round(sigma, 9) AS sigma FROM comps"))
def q_ci_to_sigma(spark, sf):
    return A.survey_components(inputs(spark, sf)[0]).select("scenario_id", "source", rr("sigma", 9))


@register(
    "grid_cross_components",
    sql("SELECT scenario_id, source, i, round(x, 9) AS x, round(pdf, 9) AS pdf FROM cpdf"),
)
def q_grid_cross_components(spark, sf):
    g = A.grid_cross_components(*inputs(spark, sf))
    return g.select("scenario_id", "source", "i", rr("x", 9), rr("pdf", 9))


@register(
    "normal_pdf",
    sql(
        f"""SELECT scenario_id, year,
                   round(exp(-(((year - posterior_mean) / posterior_std) * ((year - posterior_mean) / posterior_std)) / {dbl(2)})
                         / {SQRT2PI} / posterior_std, 9) AS pdf
            FROM (SELECT *, CAST(unnest(range(base_year, base_year + 40)) AS INTEGER) AS year FROM post)"""
    ),
)
def q_normal_pdf(spark, sf):
    post = post_of(spark, sf)
    y = year_spine(post, F.col("base_year"), F.col("base_year") + 40)
    return y.select("scenario_id", "year", F.round(stats.normal_pdf("year", "posterior_mean", "posterior_std"), 9).alias("pdf"))


@register("survey_mixture_pdf", sql("SELECT scenario_id, i, round(x, 9) AS x, round(survey_pdf, 9) AS survey_pdf FROM mix"))
def q_survey_mixture_pdf(spark, sf):
    return A.survey_mixture(*inputs(spark, sf)).select("scenario_id", "i", rr("x", 9), rr("survey_pdf", 9))


@register("mixture_mean", sql("SELECT scenario_id, i, round(survey_pdf, 9) AS survey_pdf FROM mix"))
def q_mixture_mean(spark, sf):
    return A.survey_mixture(*inputs(spark, sf)).select("scenario_id", "i", rr("survey_pdf", 9))


@register(
    "growth_to_lognormal",
    sql("""SELECT scenario_id, round(mean_years, 9) AS mean_years, round(std_years, 9) AS std_years,
                  round(shape, 9) AS shape, round(log_scale, 9) AS log_scale FROM growth"""),
)
def q_growth_to_lognormal(spark, sf):
    g = A.growth_lognormal(inputs(spark, sf)[1])
    return g.select("scenario_id", *[rr(c, 9) for c in ("mean_years", "std_years", "shape", "log_scale")])


@register("lognormal_pdf_shifted", sql("SELECT scenario_id, i, round(x, 9) AS x, round(growth_pdf, 9) AS growth_pdf FROM dgrid"))
def q_lognormal_pdf_shifted(spark, sf):
    g = A.density_grid(*inputs(spark, sf))
    return g.select("scenario_id", "i", rr("x", 9), rr("growth_pdf", 9))


@register(
    "positive_support",
    sql(
        f"""SELECT scenario_id, year, round(CASE WHEN year - base_year > 0 THEN
               exp(-(ln((year - base_year) / exp(log_scale)) * ln((year - base_year) / exp(log_scale))) / (shape * shape * {dbl(2)}))
               / (shape * ((year - base_year) / exp(log_scale)) * {SQRT2PI}) / exp(log_scale) ELSE {dbl(0)} END, 9) AS growth_pdf
            FROM (SELECT *, CAST(unnest(range(base_year - 3, base_year + 41)) AS INTEGER) AS year FROM growth)"""
    ),
)
def q_positive_support(spark, sf):
    """P10: the shifted growth density at whole years around the origin (0 at
    and before it)."""
    g = A.growth_lognormal(inputs(spark, sf)[1])
    y = year_spine(g, F.col("base_year") - 3, F.col("base_year") + 41)
    return y.select(
        "scenario_id", "year",
        F.round(stats.lognormal_pdf_shifted("year", "base_year", "shape", "log_scale"), 9).alias("growth_pdf"),
    )


@register("blend_densities", sql("SELECT scenario_id, i, round(combined, 9) AS combined FROM dgrid2"))
def q_blend_densities(spark, sf):
    return A.density_grid(*inputs(spark, sf)).select("scenario_id", "i", rr("combined", 9))


@register(
    "density_align",
    sql("""SELECT scenario_id, i, round(x, 9) AS x, round(survey_pdf, 9) AS survey_pdf,
                  round(growth_pdf, 9) AS growth_pdf, round(combined, 9) AS combined FROM dgrid2"""),
)
def q_density_align(spark, sf):
    g = A.density_grid(*inputs(spark, sf))
    return g.select("scenario_id", "i", *[rr(c, 9) for c in ("x", "survey_pdf", "growth_pdf", "combined")])


@register(
    "trapezoid_integral",
    sql("SELECT scenario_id, round(sum(s0), 9) AS integral FROM p0 GROUP BY 1"),
)
def q_trapezoid_integral(spark, sf):
    g = A.density_grid(*inputs(spark, sf))
    return A.trapezoid_integral(g).select("scenario_id", rr("integral", 9))


@register("normalise_density", sql("SELECT scenario_id, i, round(density, 9) AS density FROM p1"))
def q_normalise_density(spark, sf):
    g = A.posterior_grid(A.density_grid(*inputs(spark, sf)))
    return g.select("scenario_id", "i", rr("density", 9))


@register("first_moment", sql("SELECT scenario_id, round(posterior_mean, 6) AS posterior_mean FROM post"))
def q_first_moment(spark, sf):
    return post_of(spark, sf).select("scenario_id", rr("posterior_mean", 6))


@register("central_moment_std", sql("SELECT scenario_id, round(posterior_std, 6) AS posterior_std FROM post"))
def q_central_moment_std(spark, sf):
    return post_of(spark, sf).select("scenario_id", rr("posterior_std", 6))


@register(
    "posterior_moments",
    sql("""SELECT scenario_id, base_year, round(integral, 9) AS integral, round(posterior_mean, 6) AS posterior_mean,
                  round(posterior_std, 6) AS posterior_std FROM post"""),
)
def q_posterior_moments(spark, sf):
    p = post_of(spark, sf)
    return p.select("scenario_id", "base_year", rr("integral", 9), rr("posterior_mean", 6), rr("posterior_std", 6))


@register(
    "density_curves",
    sql(
        f"""SELECT scenario_id, i, round(x, 9) AS x, round(survey_pdf, 9) AS survey_pdf, round(growth_pdf, 9) AS growth_pdf,
                   round(exp(-(((x - posterior_mean) / posterior_std) * ((x - posterior_mean) / posterior_std)) / {dbl(2)})
                         / {SQRT2PI} / posterior_std, 9) AS posterior_pdf
            FROM pgrid"""
    ),
)
def q_density_curves(spark, sf):
    d = A.density_curves(*inputs(spark, sf))
    return d.select("scenario_id", "i", *[rr(c, 9) for c in ("x", "survey_pdf", "growth_pdf", "posterior_pdf")])


# --- D8-D15, D17, A6, J2, J6, P5, P6 -------------------------------------------------

MAIN_YEARS = (2030, 2035, 2040, 2050, 2060)


@register(
    "normal_cdf_by_year",
    sql(
        f"""SELECT scenario_id, year, round({stats.normal_cdf_sql('z')}, 6) AS cumulative_probability FROM (
              SELECT scenario_id, year, (year - posterior_mean) / posterior_std AS z
              FROM post CROSS JOIN (VALUES {", ".join(f"({y})" for y in MAIN_YEARS)}) t(year))"""
    ),
)
def q_normal_cdf_by_year(spark, sf):
    post = post_of(spark, sf)
    y = post.select("*", F.explode(F.array(*[F.lit(v) for v in MAIN_YEARS])).alias("year"))
    return A.with_cumulative(y).select("scenario_id", "year", rr("cumulative_probability", 6))


def _yp_sql(name, n):
    return sql(
        f"""SELECT scenario_id, year, round(cumulative_probability, 6) AS cumulative_probability,
                   round(yearly_probability, 6) AS yearly_probability FROM {name}""",
        years_cte(name, 0, n),
    )


def _yp_out(df):
    return df.select("scenario_id", "year", rr("cumulative_probability", 6), rr("yearly_probability", 6))


@register("year_probabilities", _yp_sql("yp15", 15))
def q_year_probabilities(spark, sf):
    return _yp_out(A.year_probabilities(post_of(spark, sf), 0, 15))


@register("cumulative_curve", _yp_sql("yp40", 40))
def q_cumulative_curve(spark, sf):
    return _yp_out(A.year_probabilities(post_of(spark, sf), 0, 40))


@register(
    "impact_factor",
    sql(
        """SELECT scenario_id, year, round(agi_probability, 6) AS agi_probability,
                  round(stock_impact_factor, 6) AS stock_impact_factor FROM imp3""",
        years_cte("yp3", 0, 3) + impact_cte("imp3", "yp3"),
    ),
)
def q_impact_factor(spark, sf):
    imp = A.impact_factor(A.year_probabilities(post_of(spark, sf), 0, 3))
    return imp.select("scenario_id", "year", rr("agi_probability", 6), rr("stock_impact_factor", 6))


@register(
    "year_panel",
    sql(
        """SELECT y.scenario_id, y.year, round(y.cumulative_probability, 6) AS cumulative_probability,
                  round(y.yearly_probability, 6) AS yearly_probability,
                  round(i.stock_impact_factor, 6) AS stock_impact_factor
           FROM yp20 y JOIN imp20 i USING (scenario_id, year)""",
        years_cte("yp20", 0, 20) + impact_cte("imp20", "yp20"),
    ),
)
def q_year_panel(spark, sf):
    p = A.year_panel(post_of(spark, sf), 20)
    return p.select(
        "scenario_id", "year", rr("cumulative_probability", 6), rr("yearly_probability", 6), rr("stock_impact_factor", 6)
    )


@register(
    "proximity_weighted_sum",
    sql(
        f"""SELECT a.scenario_id, a.year, round(coalesce(sum(b.yearly_probability * (1 - (b.year - a.year) / {dbl(5)})), 0), 6)
                   AS weighted_future
            FROM yp20 a LEFT JOIN yp20 b ON a.scenario_id = b.scenario_id AND b.year > a.year AND b.year <= a.year + 5
            GROUP BY 1, 2""",
        years_cte("yp20", 0, 20),
    ),
)
def q_proximity_weighted_sum(spark, sf):
    w = A.proximity_weighted_sum(A.year_probabilities(post_of(spark, sf), 0, 20))
    return w.select("scenario_id", "year", rr("weighted_future", 6))


@register(
    "forward_range_join",
    sql(
        f"""SELECT a.scenario_id, a.year, b.year AS future_year, round(b.yearly_probability, 6) AS future_yearly,
                   round(1 - (b.year - a.year) / {dbl(5)}, 6) AS weight
            FROM yp20 a JOIN yp20 b ON a.scenario_id = b.scenario_id AND b.year > a.year AND b.year <= a.year + 5""",
        years_cte("yp20", 0, 20),
    ),
)
def q_forward_range_join(spark, sf):
    j = A.forward_range_join(A.year_probabilities(post_of(spark, sf), 0, 20))
    return j.select("scenario_id", "year", "future_year", rr("future_yearly", 6), rr("weight", 6))


@register(
    "year_range_predicate",
    sql(
        f"""SELECT scenario_id, year, round(yearly_probability, 6) AS yearly_probability FROM yp20
            WHERE year > {BASE_YEAR} AND year <= {BASE_YEAR + 5}""",
        years_cte("yp20", 0, 20),
    ),
)
def q_year_range_predicate(spark, sf):
    """The supplied years in ``(base, base + duration]``."""
    yp = A.year_probabilities(post_of(spark, sf), 0, 20)
    y = F.col("year")
    return yp.filter((y > BASE_YEAR) & (y <= BASE_YEAR + SC.IMPACT_DURATION)).select(
        "scenario_id", "year", rr("yearly_probability", 6)
    )


@register(
    "lookup_year",
    sql(
        f"""SELECT scenario_id, year, round(agi_probability, 6) AS agi_probability,
                   round(stock_impact_factor, 6) AS stock_impact_factor FROM imp3 WHERE year = {BASE_YEAR + 1}""",
        years_cte("yp3", 0, 3) + impact_cte("imp3", "yp3"),
    ),
)
def q_lookup_year(spark, sf):
    """P5: single-year equality lookup in the impact table."""
    imp = A.impact_factor(A.year_probabilities(post_of(spark, sf), 0, 3))
    return imp.filter(F.col("year") == BASE_YEAR + 1).select(
        "scenario_id", "year", rr("agi_probability", 6), rr("stock_impact_factor", 6)
    )


@register(
    "horizon_probability",
    sql(
        f"SELECT scenario_id, year, round(cumulative_probability, 6) AS agi_probability FROM yp15 WHERE year = {BASE_YEAR + 5}",
        years_cte("yp15", 0, 15),
    ),
)
def q_horizon_probability(spark, sf):
    return A.horizon_probability(post_of(spark, sf)).select("scenario_id", "year", rr("agi_probability", 6))


@register(
    "percentile_years",
    sql(
        "SELECT scenario_id, percentile, round(posterior_mean + posterior_std * z, 6) AS year FROM post CROSS JOIN (VALUES "
        + ", ".join(f"({p}, {dbl(z)})" for p, z in stats.PERCENTILE_Z.items())
        + ") t(percentile, z)"
    ),
)
def q_percentile_years(spark, sf):
    return A.percentile_years(post_of(spark, sf)).select("scenario_id", "percentile", rr("year", 6))


THRESH_SQL = "(VALUES " + ", ".join(f"({dbl(t)})" for t in A.THRESHOLDS) + ") t(threshold)"


@register(
    "nearest_threshold_year",
    sql(
        f"""SELECT scenario_id, threshold, arg_min(year, abs(cumulative_probability - threshold)) AS year
            FROM yp40 CROSS JOIN {THRESH_SQL} GROUP BY 1, 2""",
        years_cte("yp40", 0, 40),
    ),
)
def q_nearest_threshold_year(spark, sf):
    return A.nearest_threshold_year(A.year_probabilities(post_of(spark, sf), 0, 40))


@register(
    "first_crossing_year",
    sql(
        f"""SELECT scenario_id, threshold, min(CASE WHEN cumulative_probability >= threshold THEN year END) AS year
            FROM yp40 CROSS JOIN (VALUES ({dbl(0.1)}), ({dbl(0.5)})) t(threshold) GROUP BY 1, 2""",
        years_cte("yp40", 0, 40),
    ),
)
def q_first_crossing_year(spark, sf):
    return A.first_crossing_year(A.year_probabilities(post_of(spark, sf), 0, 40))


STRIDE_YEARS = list(range(BASE_YEAR, BASE_YEAR + 30, 5))


@register(
    "stride_probabilities",
    sql(
        "SELECT scenario_id, "
        + ", ".join(f"round(max(CASE WHEN year = {y} THEN cumulative_probability END), 6) AS agi_prob_{y}" for y in STRIDE_YEARS)
        + " FROM ys GROUP BY 1",
        years_cte("ys", 0, 30, 5),
    ),
)
def q_stride_probabilities(spark, sf):
    s = A.stride_probabilities(post_of(spark, sf), BASE_YEAR)
    return s.select("scenario_id", *[rr(f"agi_prob_{y}", 6) for y in STRIDE_YEARS])
