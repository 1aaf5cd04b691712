"""Registered queries: the posterior's integrated distribution and its inverse, a parameter sweep,
Monte Carlo quantiles of the forecast, and expanding-window folds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import folds as FO
from ..operators import integrated as IN
from ..operators import simulate as MC
from ..operators import windows as W
from ..operators.arrival import density_grid
from ..plans.sequence import Series, over_series
from ..sources import scenarios as SC
from ..sources.spines import year_spine
from .arrival import CHAIN, N, SPAN, SQRT2PI, inputs, sql
from .common import BARS_SQL, dbl, orders_bars, register
from .forecast import fsql, path_of

S = Series("symbol", "bar_date")


def rr(name, p):
    return F.round(F.col(name), p).alias(name)


# --- integrated distribution (D8, D11 without the normal approximation) --------------------

_CDF = """,
cdf AS (SELECT scenario_id, i, x, sum(coalesce(s0, 0)) OVER (PARTITION BY scenario_id ORDER BY i ROWS UNBOUNDED PRECEDING)
               / sum(s0) OVER (PARTITION BY scenario_id) AS cdf FROM p0),
steps AS (SELECT * FROM (SELECT *, lag(x) OVER w AS x0, lag(cdf) OVER w AS cdf0 FROM cdf WINDOW w AS (PARTITION BY scenario_id ORDER BY i))
          WHERE x0 IS NOT NULL)"""
FIRST, YEARS = -1, 44  # years from one before the base year to some beyond the grid


def dist_of(spark, sf):
    return IN.integrated_distribution(density_grid(*inputs(spark, sf)))


@register("integrated_distribution", sql("SELECT scenario_id, i, round(x, 9) AS x, round(cdf, 9) AS cdf FROM cdf", _CDF))
def q_integrated_distribution(spark, sf):
    """The density's own distribution on the grid."""
    return dist_of(spark, sf).select("scenario_id", "i", rr("x", 9), rr("cdf", 9))


@register(
    "integrated_quantiles",
    sql(f"""SELECT scenario_id, percentile, round(x0 + (percentile - cdf0) / (cdf - cdf0) * (x - x0), 6) AS year
            FROM steps JOIN (VALUES {", ".join(f"({dbl(p)})" for p in IN.PERCENTILES)}) t(percentile)
            ON cdf0 < percentile AND percentile <= cdf""", _CDF),
)
def q_integrated_quantiles(spark, sf):
    """Years at which the distribution reaches each percentile."""
    return IN.integrated_quantiles(dist_of(spark, sf)).select("scenario_id", "percentile", rr("year", 6))


@register(
    "integrated_probabilities",
    sql(f"""SELECT scenario_id, year, round(p, 6) AS cumulative_probability,
              round(p - coalesce(lag(p) OVER (PARTITION BY scenario_id ORDER BY year), 0), 6) + {dbl(0)} AS yearly_probability
            FROM (SELECT y.scenario_id, y.year, coalesce(max(cdf0 + (y.year - x0) / (x - x0) * (cdf - cdf0)), CASE WHEN y.year < max(y.base_year) THEN 0 ELSE 1 END) AS p
                  FROM (SELECT scenario_id, base_year, CAST(base_year + k AS INTEGER) AS year FROM params, range({FIRST}, {FIRST + YEARS}) t(k)) y
                  LEFT JOIN steps s ON s.scenario_id = y.scenario_id AND s.x0 <= y.year AND y.year <= s.x GROUP BY 1, 2)""", _CDF),
)
def q_integrated_probabilities(spark, sf):
    """Cumulative and yearly probabilities of the distribution itself."""
    surveys, params = inputs(spark, sf)
    years = year_spine(params.select("scenario_id", "base_year"), F.col("base_year") + FIRST, F.col("base_year") + FIRST + YEARS)
    out = IN.integrated_probabilities(IN.integrated_distribution(density_grid(surveys, params)), years)
    return out.select("scenario_id", "year", rr("cumulative_probability", 6),
                      (F.round("yearly_probability", 6) + F.lit(0.0)).alias("yearly_probability"))  # no minus zero


# --- parameter sweep ------------------------------------------------------------------

WEIGHTS, FACTORS = (0.3, 0.5, 0.7), (0.9, 1.0, 1.1)


@register(
    "parameter_sweep",
    f"""WITH {CHAIN},
fac AS (SELECT *, ln(mean_years) - shape * shape * {dbl(0.5)} AS log_scale FROM (
  SELECT *, sqrt(ln(1 + {dbl(SC.GROWTH_SD_RATIO)} * {dbl(SC.GROWTH_SD_RATIO)})) AS shape FROM (
    SELECT scenario_id, base_year, growth_factor, ln(compute_agi_estimate / compute_current) / ln(compute_growth_rate * growth_factor) AS mean_years
    FROM params CROSS JOIN (VALUES {", ".join(f"({dbl(f)})" for f in FACTORS)}) t(growth_factor)))),
blend AS (
  SELECT m.scenario_id, m.i, m.x, m.x - f.base_year AS t, f.base_year, f.growth_factor, w.survey_weight,
         w.survey_weight * m.survey_pdf + (1 - w.survey_weight) * (CASE WHEN m.x > f.base_year THEN
           exp(-(ln((m.x - f.base_year) / exp(log_scale)) * ln((m.x - f.base_year) / exp(log_scale))) / (2 * shape * shape))
           / (shape * (m.x - f.base_year) * {SQRT2PI}) ELSE 0 END) AS d
  FROM mix m JOIN fac f USING (scenario_id) CROSS JOIN (VALUES {", ".join(f"({dbl(w)})" for w in WEIGHTS)}) w(survey_weight)),
area AS (SELECT *, lag(t) OVER w AS t0, lag(d) OVER w AS d0 FROM blend WINDOW w AS (PARTITION BY scenario_id, growth_factor, survey_weight ORDER BY i)),
mom AS (SELECT scenario_id, base_year, growth_factor, survey_weight, sum((t - t0) * (d + d0) / 2) AS m0,
          sum((t - t0) * (t * d + t0 * d0) / 2) AS m1, sum((t - t0) * (t * t * d + t0 * t0 * d0) / 2) AS m2
        FROM area WHERE t0 IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT scenario_id, survey_weight, growth_factor, round(m0, 6) AS integral, round(base_year + m1 / m0, 6) AS posterior_mean,
       round(sqrt(m2 / m0 - (m1 / m0) * (m1 / m0)), 6) AS posterior_std FROM mom""",
)
def q_parameter_sweep(spark, sf):
    """Posterior moments over survey weights and growth factors."""
    out = IN.parameter_sweep(*inputs(spark, sf), WEIGHTS, FACTORS, N, SPAN)
    return out.select("scenario_id", "survey_weight", "growth_factor", rr("integral", 6), rr("posterior_mean", 6), rr("posterior_std", 6))


# --- Monte Carlo ----------------------------------------------------------------------

N_PATHS, MC_SEED = 200, 42
_G = dbl(MC.gamma())


def _uniform_sql(at: int) -> str:
    return f"((CAST('0x' || substr(h, {at}, 13) AS BIGINT) + {dbl(0.5)}) / {dbl(float(1 << 52))})"


@register(
    "monte_carlo_quantiles",
    fsql(f""", vol AS (SELECT symbol, stddev_samp(r) AS volatility FROM (
        SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date)) AS r FROM bars) GROUP BY 1),
drift AS (SELECT symbol, scenario_id, step, close, ln(forecasted_close / coalesce(lag(forecasted_close) OVER (PARTITION BY symbol, scenario_id ORDER BY step), close)) AS growth FROM path),
drawn AS (SELECT d.*, k AS path, volatility, md5('{MC_SEED}|' || symbol || '|' || scenario_id || '|' || CAST(k AS VARCHAR) || '|' || CAST(step AS VARCHAR)) AS h
          FROM drift d JOIN vol USING (symbol), range({N_PATHS}) t(k) WHERE growth IS NOT NULL),
moved AS (SELECT *, growth + volatility * sqrt(-2 * ln({_uniform_sql(1)})) * cos({dbl(2 * math.pi)} * {_uniform_sql(14)}) AS r FROM drawn),
priced AS (SELECT symbol, scenario_id, step, close * exp(sum(r) OVER (PARTITION BY symbol, scenario_id, path ORDER BY step ROWS UNBOUNDED PRECEDING)) AS price FROM moved),
ranked AS (SELECT *, ceil(ln(price) / {dbl(math.log(MC.gamma()))}) AS bin, row_number() OVER (PARTITION BY symbol, scenario_id, step ORDER BY price) AS place FROM priced)
SELECT symbol, scenario_id, step, quantile, round(ln({dbl(2 / (MC.gamma() + 1))} * power({_G}, bin)), 6) AS log_price
FROM ranked JOIN (VALUES {", ".join(f"({dbl(q)}, {max(1, math.ceil(q * N_PATHS - 1e-9))})" for q in MC.QUANTILES)}) t(quantile, wanted) ON place = wanted"""),
)
def q_monte_carlo_quantiles(spark, sf):
    """Quantiles per forecast step of seeded price paths around the deterministic forecast, as logarithms:
    the test series' volatility spreads prices over many orders of magnitude."""
    paths = MC.simulate_paths(path_of(spark, sf), MC.daily_volatility(orders_bars(spark, sf), S), N_PATHS, MC_SEED)
    keys = ["symbol", "scenario_id", "step"]
    return MC.sketch_quantiles(MC.quantile_sketch(paths, keys, "price"), keys).select(*keys, "quantile", F.round(F.log("value"), 6).alias("log_price"))


# --- expanding-window folds -----------------------------------------------------------

EMBARGO = 30  # the target looks so many rows ahead


def targets_of(spark, sf):
    bars = orders_bars(spark, sf).select("symbol", "bar_date", "close")
    out = over_series(bars, lambda d, s: d.withColumn("y", W.lead_return("close", s, EMBARGO)), S, back=0, ahead=32)
    return out.where("y IS NOT NULL").select("symbol", "bar_date", "y")


@register(
    "expanding_folds",
    f"""WITH bars AS ({BARS_SQL}),
t AS (SELECT symbol, bar_date, lead(close, {EMBARGO}) OVER (PARTITION BY symbol ORDER BY bar_date) / close - 1 AS y FROM bars),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM t WHERE y IS NOT NULL),
f AS (SELECT r.*, fold, n - ({FO.FOLDS + 1} - fold) * (n // {FO.FOLDS + 1}) AS a, n // {FO.FOLDS + 1} AS size FROM r, range(1, {FO.FOLDS + 1}) g(fold)),
m AS (SELECT symbol, fold, avg(y) AS mean_train, count(*) AS n_train FROM f WHERE rn < a - {EMBARGO} GROUP BY 1, 2),
u AS (SELECT f.*, avg(y) OVER (PARTITION BY symbol, fold) AS mean_test FROM f WHERE rn >= a AND rn < a + size)
SELECT symbol, CAST(fold AS INTEGER) AS fold, max(n_train) AS n_train, count(*) AS n_test, round(max(mean_train), 6) AS mean_train,
       round(1 - sum((y - mean_train) * (y - mean_train)) / sum((y - mean_test) * (y - mean_test)), 6) AS r2
FROM u JOIN m USING (symbol, fold) GROUP BY 1, 2""",
)
def q_expanding_folds(spark, sf):
    """Scores of the training mean on five expanding folds with an embargo."""
    out = FO.mean_fold_scores(FO.numbered(targets_of(spark, sf), S), "y", FO.FOLDS, EMBARGO, S)
    return out.select("symbol", "fold", "n_train", "n_test", rr("mean_train", 6), rr("r2", 6))
