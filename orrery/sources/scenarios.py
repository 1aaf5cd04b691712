"""Survey and growth-parameter sources (S6, S7) keyed by ``scenario_id``.

The reference holds one fixed table of six surveys and one parameter dict.
Here every scenario carries its own survey components and parameters; the
registered queries derive them from ``lineitem`` (scenario = return flag,
survey source = supplier), the tests also use the reference's own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SURVEY_SCHEMA = T.StructType(
    [
        T.StructField("scenario_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("median_year", T.IntegerType()),
        T.StructField("ci_low", T.IntegerType()),
        T.StructField("ci_high", T.IntegerType()),
    ]
)

# The reference's expert surveys (source, median, 95 % low, 95 % high).
REFERENCE_SURVEYS = [
    ("AI Impacts 2022", 2045, 2035, 2065),
    ("Grace et al. 2020", 2050, 2036, 2075),
    ("Zhang et al. 2022", 2040, 2030, 2060),
    ("Metaculus Community", 2035, 2028, 2055),
    ("AI Leaders Survey", 2032, 2027, 2045),
    ("ML Researchers", 2039, 2029, 2058),
]

# The reference's growth parameters (FLOP now, FLOP needed, yearly growth)
# and the three it declares but never reads.
COMPUTE_CURRENT = 1e26
COMPUTE_TARGET = 1e30
COMPUTE_GROWTH_RATE = 1.3
PARAMETER_SCALING_EXPONENT = 0.75
DATA_SCALING_EXPONENT = 0.5
EFFECTIVE_HORIZON = 15

# Model settings of the reference.
EXPERT_WEIGHT = 0.5
GROWTH_WEIGHT = 0.5
GROWTH_SD_RATIO = 0.3
GRID_POINTS = 1000
GRID_YEARS = 40
IMPACT_THRESHOLD = 0.5
IMPACT_LAG = 2
IMPACT_DURATION = 5
DISCOUNT_RATE = 0.1

PARAM_COLUMNS = [
    "scenario_id", "base_year", "compute_current", "compute_agi_estimate", "compute_growth_rate",
    "expert_weight", "growth_weight",
]


def reference_surveys(spark: SparkSession, scenario_id: str = "base") -> DataFrame:
    """S6 with the reference's six surveys (for tests and single-scenario runs)."""
    rows = [(scenario_id, *r) for r in REFERENCE_SURVEYS]
    return spark.createDataFrame(rows, SURVEY_SCHEMA)


def reference_params(spark: SparkSession, base_year: int, scenario_id: str = "base") -> DataFrame:
    """S7 with the reference's growth parameters."""
    return spark.createDataFrame(
        [(scenario_id, base_year, COMPUTE_CURRENT, COMPUTE_TARGET, COMPUTE_GROWTH_RATE, EXPERT_WEIGHT, GROWTH_WEIGHT)],
        "scenario_id string, base_year int, compute_current double, compute_agi_estimate double, "
        "compute_growth_rate double, expert_weight double, growth_weight double",
    )


def supplier_moments(lineitem: DataFrame) -> DataFrame:
    """Per (return flag, supplier), in one pass over ``lineitem`` (partial
    aggregation, one shuffle of one row per task and group): mean and sample
    std of the quantity, line count, finished lines.  Surveys (S6) and
    parameters (S7) are both derived from this table."""
    q = F.col("l_quantity")
    return lineitem.groupBy(F.col("l_returnflag").alias("scenario_id"), F.col("l_suppkey").alias("supp")).agg(
        F.avg(q).alias("q_mean"),
        F.stddev_samp(q).alias("q_std"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("l_linestatus") == "F", F.lit(1))).alias("n_finished"),
    )


def surveys_from_moments(moments: DataFrame) -> DataFrame:
    """One survey component per (return flag, supplier).

    median = 2020 + floor(mean quantity); the interval is median - floor(sd)
    to median + floor(1.5 sd) (skewed to later years, as the real surveys);
    components without a proper interval (``ci_high <= ci_low``) are dropped.
    """
    med = F.lit(2020) + F.floor(F.col("q_mean"))
    out = moments.select(
        "scenario_id",
        F.concat(F.lit("supp-"), F.col("supp").cast("string")).alias("source"),
        med.cast("int").alias("median_year"),
        (med - F.floor(F.col("q_std"))).cast("int").alias("ci_low"),
        (med + F.floor(F.col("q_std") * 1.5)).cast("int").alias("ci_high"),
    )
    return out.filter(F.col("ci_high") > F.col("ci_low"))


def params_from_moments(moments: DataFrame, base_year: int) -> DataFrame:
    """S7 per scenario: the reference's growth parameters, with the yearly
    compute growth set to 1.25 + 0.1 * (share of finished line items)."""
    share = F.sum("n_finished").cast("double") / F.sum("n_lines").cast("double")
    return moments.groupBy("scenario_id").agg(
        F.lit(base_year).alias("base_year"),
        F.lit(COMPUTE_CURRENT).alias("compute_current"),
        F.lit(COMPUTE_TARGET).alias("compute_agi_estimate"),
        (F.lit(1.25) + F.lit(0.1) * share).alias("compute_growth_rate"),
        F.lit(EXPERT_WEIGHT).alias("expert_weight"),
        F.lit(GROWTH_WEIGHT).alias("growth_weight"),
    )


def scenario_inputs(lineitem: DataFrame, base_year: int) -> tuple[DataFrame, DataFrame]:
    """``(surveys, params)`` from one pass over ``lineitem``, at every size.

    The two tables, and the many places of the arrival chain that use them, need different columns of
    the per-supplier statistics; Catalyst prunes each use separately, so without a cut every use would
    scan ``lineitem`` again.  The statistics (one row per flag and supplier) are therefore written once
    as a table in the shared checkpoint folder and every use reads that.
    """
    from ..session import write_through

    moments = write_through(supplier_moments(lineitem), "supplier-moments")
    return surveys_from_moments(moments), params_from_moments(moments, base_year)


def surveys_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """S6 straight from ``lineitem`` (see :func:`surveys_from_moments`)."""
    return surveys_from_moments(supplier_moments(lineitem))


def params_from_lineitem(lineitem: DataFrame, base_year: int) -> DataFrame:
    """S7 straight from ``lineitem`` (see :func:`params_from_moments`)."""
    return params_from_moments(supplier_moments(lineitem), base_year)


def growth_params_table(params: DataFrame) -> DataFrame:
    """S7 in the reference's shape: all six parameters, including the three
    it never reads."""
    return params.select(
        "scenario_id", "compute_current", "compute_agi_estimate", "compute_growth_rate",
        F.lit(PARAMETER_SCALING_EXPONENT).alias("parameter_scaling_exponent"),
        F.lit(DATA_SCALING_EXPONENT).alias("data_scaling_exponent"),
        F.lit(EFFECTIVE_HORIZON).alias("effective_horizon"),
    )


def exposure_plan(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Forecast plan ``(symbol, scenario_id)``: a series is forecast under the
    scenarios its own line items carry (order priority x return flag seen on
    the same order).  Line items are first reduced to their distinct (order,
    flag) pairs, a hash aggregate with map-side partials, before they meet the
    equi join."""
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("symbol"))
    li = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("scenario_id")).distinct()
    return o.join(li, "k").select("symbol", "scenario_id").where("scenario_id IS NOT NULL").distinct()
