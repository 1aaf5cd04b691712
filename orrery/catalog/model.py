"""Registered queries: random forest (M1-M4, F3), R^2 (A7), the whole forecast
job (G7) and the report/summary outputs (S13, S14).

Forest results depend on Spark's binning, so M1-M4 and G7 are rows-only
checks; A7, S13 and S14 use the deterministic predictor and have SQL.  Every
query that needs the forest fits it on all training rows.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf_sql
from ..operators import arrival as A
from ..operators import features as FE
from ..operators import forecast as G
from ..operators import model as M
from ..plans.sequence import Series
from ..session import scratch_path
from ..sources.sinks import write_json
from .common import dbl, orders_bars, register
from .features import F1_SQL_BODY, f1_of, landscape_of
from .forecast import BASE, DAYS, FORECAST_SQL, impact_of, post_of, q_horizon_summary, start_of, summary_sql

S = Series("symbol", "bar_date")
COLS = FE.feature_columns()


def split_of(spark, sf):
    return FE.features_with_split(orders_bars(spark, sf), S, 0.2, "ceil")


def split_features(spark, sf):
    """The split rows with the constants of every scenario."""
    return FE.with_constants(split_of(spark, sf), landscape_of(spark, sf))


def fitted(spark, sf):
    """The forest of the training rows: fitted by whichever query comes first, then read."""
    return M.stored_forest(split_features(spark, sf).filter(~F.col("is_test")), COLS)


def latest_features(spark, sf):
    """The newest feature row per symbol, target allowed to be NULL (the row a
    forecast predicts from)."""
    raw = FE.raw_features(orders_bars(spark, sf), S).drop(FE.TARGET).dropna("any")
    last = G.latest_row(raw)
    return FE.with_constants(last, landscape_of(spark, sf))


@register("rf_train")
def q_rf_train(spark, sf):
    """M1: the fitted forest as one row (trees, nodes, features, depth)."""
    return M.forest_summary(spark, fitted(spark, sf))


@register(
    "feature_vector",
    F1_SQL_BODY + " SELECT symbol, scenario_id, bar_date, "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS f{i}" for i, c in enumerate(COLS)) + " FROM f1",
)
def q_feature_vector(spark, sf):
    """feature columns assembled in model order, shown entry by entry."""
    v = vector_to_array("features")
    return M.feature_vector(f1_of(spark, sf), COLS).select(
        "symbol", "scenario_id", "bar_date", *[F.round(v[i], 6).alias(f"f{i}") for i in range(len(COLS))])


@register("rf_predict")
def q_rf_predict(spark, sf):
    """M2: predicted 30-row return from each symbol's latest feature row, per scenario."""
    p = M.predict(fitted(spark, sf), latest_features(spark, sf))
    return p.select("symbol", "scenario_id", "bar_date", F.col("prediction").alias("predicted_return"))


@register("rf_evaluate")
def q_rf_evaluate(spark, sf):
    """M3: R^2 on train and test rows."""
    return scores(spark, sf)


def scores(spark, sf, forest=None):
    sp = split_features(spark, sf)
    return M.evaluate(forest or fitted(spark, sf), sp.filter(~F.col("is_test")), sp.filter(F.col("is_test")))


@register("feature_importance_topk")
def q_feature_importance_topk(spark, sf):
    """M4: ten largest feature importances."""
    return M.feature_importance_topk(spark, fitted(spark, sf), COLS, 10)


def forest_start(spark, sf, forest=None):
    """Forecast start rows with the forest's prediction per symbol and scenario."""
    pred = M.predict(forest or fitted(spark, sf), latest_features(spark, sf)).select(
        "symbol", "scenario_id", F.col("prediction").alias("predicted_return")
    )
    return start_of(spark, sf).drop("predicted_return").join(pred, ["symbol", "scenario_id"])


@register("forecast_job")
def q_forecast_job(spark, sf):
    """Bars -> indicators -> features -> forest -> impact -> path -> bands."""
    path = G.forecast_path(forest_start(spark, sf), impact_of(spark, sf), DAYS)
    return G.uncertainty_band(path).select(
        "symbol", "scenario_id", "step", "forecast_date", "forecasted_close", "upper_bound", "lower_bound"
    )


# Parameters of a run that its summary states.
GENERATION_TIME = "2002-01-01T00:00:00"
HISTORICAL_YEARS = 5


@register("forecast_job_summary")
def q_forecast_job_summary(spark, sf):
    """G7's last step: per (symbol, scenario) the horizons of the forest's forecast, the arrival
    probability every five years, the run's parameters and the forest's scores."""
    post, forest = post_of(spark, sf), fitted(spark, sf)
    path = G.forecast_path(forest_start(spark, sf, forest), impact_of(spark, sf, post), DAYS)
    probs = A.stride_probabilities(post, BASE)
    return G.path_summary(path, DAYS).join(probs, "scenario_id").withColumns({
        "generation_time": F.lit(GENERATION_TIME), "historical_years": F.lit(HISTORICAL_YEARS), "forecast_days": F.lit(DAYS),
    }).crossJoin(F.broadcast(scores(spark, sf, forest)))

_SCORES_SQL = F1_SQL_BODY + f""",
sp AS (SELECT symbol, {FE.TARGET} AS y, rn >= n - ceil(n * {dbl(0.2)}) AS is_test FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS rn,
                count(*) OVER (PARTITION BY symbol) AS n FROM f0)),
mu AS (SELECT symbol, avg(y) AS prediction FROM sp WHERE NOT is_test GROUP BY 1),
dev AS (SELECT is_test, y, prediction, avg(y) OVER (PARTITION BY is_test) AS yb FROM sp JOIN mu USING (symbol)),
r2 AS (SELECT is_test, 1 - sum((y - prediction) * (y - prediction)) / sum((y - yb) * (y - yb)) AS r2 FROM dev GROUP BY 1)
SELECT max(CASE WHEN NOT is_test THEN round(r2, 6) END) AS train_score, max(CASE WHEN is_test THEN round(r2, 6) END) AS test_score FROM r2"""


def mean_scores(spark, sf):
    """One row: R^2 of each symbol's mean training return on the training and the test rows."""
    sp = split_of(spark, sf).select("symbol", "is_test", FE.TARGET)
    mu = sp.filter(~F.col("is_test")).groupBy("symbol").agg(F.avg(FE.TARGET).alias("prediction"))
    r2 = M.r2_score(sp.join(mu, "symbol"), group="is_test")
    return r2.agg(F.max(F.when(~F.col("is_test"), F.round("r2", 6))).alias("train_score"),
                  F.max(F.when(F.col("is_test"), F.round("r2", 6))).alias("test_score"))


@register(
    "summary_json_sink",
    f"""SELECT s.*, '{GENERATION_TIME}' AS generation_time, {HISTORICAL_YEARS} AS historical_years, {DAYS} AS forecast_days,
               r.train_score, r.test_score FROM ({summary_sql()}) s CROSS JOIN ({_SCORES_SQL}) r""",
)
def q_summary_json_sink(spark, sf):
    """Per (symbol, scenario) summary with run metadata and scores of the deterministic
    predictor, written as JSON and read back."""
    out = q_horizon_summary(spark, sf).withColumns({
        "generation_time": F.lit(GENERATION_TIME), "historical_years": F.lit(HISTORICAL_YEARS), "forecast_days": F.lit(DAYS),
    }).crossJoin(F.broadcast(mean_scores(spark, sf)))
    path = scratch_path(spark, f"summary-{uuid.uuid4().hex}")
    write_json(out, path)
    return spark.read.schema(out.schema).json(path)


# --- A7 (deterministic predictor) -----------------------------------------------------

@register(
    "r2_score",
    F1_SQL_BODY
    + f""",
sp AS (SELECT *, rn >= n - ceil(n * {dbl(0.2)}) AS is_test FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS rn,
                count(*) OVER (PARTITION BY symbol) AS n FROM f0)),
mu AS (SELECT symbol, avg({FE.TARGET}) AS prediction FROM sp WHERE NOT is_test GROUP BY 1),
te AS (SELECT sp.symbol, sp.{FE.TARGET} AS y, mu.prediction FROM sp JOIN mu USING (symbol) WHERE is_test),
ybar AS (SELECT symbol, avg(y) AS yb FROM te GROUP BY 1)
SELECT te.symbol, round(1 - sum((y - prediction) * (y - prediction)) / sum((y - yb) * (y - yb)), 6) AS r2
FROM te JOIN ybar USING (symbol) GROUP BY 1""",
)
def q_r2_score(spark, sf):
    """Per-symbol test R^2 of the train-mean predictor."""
    sp = split_of(spark, sf)
    mu = sp.filter(~F.col("is_test")).groupBy("symbol").agg(F.avg(FE.TARGET).alias("prediction"))
    te = sp.filter(F.col("is_test")).join(mu, "symbol")
    return M.r2_score(te, FE.TARGET, "prediction", group="symbol").select("symbol", F.round("r2", 6).alias("r2"))


# --- S14 ------------------------------------------------------------------------------

REPORT_YEARS = (2030, 2035, 2040, 2050)


@register(
    "report_metrics",
    FORECAST_SQL
    + f""",
summ AS (
  SELECT p.symbol, p.scenario_id, max(p.close) AS current_price,
         max(CASE WHEN p.step = 29 THEN p.forecasted_close END) AS month_1,
         max(CASE WHEN p.step = 89 THEN p.forecasted_close END) AS month_3
  FROM path p GROUP BY 1, 2
),
probs AS (
  SELECT scenario_id, year, {normal_cdf_sql('z')} AS p FROM (
    SELECT scenario_id, year, (year - posterior_mean) / posterior_std AS z
    FROM post CROSS JOIN (VALUES {", ".join(f"({y})" for y in REPORT_YEARS)}) t(year))
),
longm AS (
  SELECT symbol, scenario_id, 'current_price' AS metric, current_price AS value FROM summ
  UNION ALL SELECT symbol, scenario_id, '1_month_price', month_1 FROM summ
  UNION ALL SELECT symbol, scenario_id, '3_months_price', month_3 FROM summ
  UNION ALL SELECT symbol, scenario_id, '1_year_price', CAST(NULL AS DOUBLE) FROM summ
  UNION ALL SELECT s.symbol, s.scenario_id, 'agi_prob_' || CAST(pr.year AS VARCHAR), pr.p
            FROM summ s JOIN probs pr USING (scenario_id)
)
SELECT symbol, scenario_id, metric, round(value, 4) AS value FROM longm""",
)
def q_report_metrics(spark, sf):
    """The report cards as a long table (price, 1- and 3-month forecast,
    1-year forecast (NULL for a 365-day run), probability by 2030/35/40/50)."""
    from ..operators.reports import report_metrics

    post = post_of(spark, sf)
    summ = G.path_summary(G.forecast_path(start_of(spark, sf), impact_of(spark, sf, post), DAYS), DAYS)
    out = report_metrics(summ, post, REPORT_YEARS)
    return out.select("symbol", "scenario_id", "metric", F.round("value", 4).alias("value"))
