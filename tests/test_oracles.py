"""Registered queries against their DuckDB oracles on the smallest tables, and
the driver entry point."""

import pytest

from paths import SF001
import __spark_entry__ as entry
from orrery.catalog import load_registry
from orrery.catalog.check import compare, duck_connect
from orrery.catalog.common import Query

FAST = [
    "bars_scan", "bars_scan_hourly", "bars_date_range", "bars_tail", "lag_features", "lead_target", "pct_change",
    "rolling_mean", "rolling_std", "ewma", "ewma_hourly", "ordinal", "indicators_all", "survey_scan",
    "growth_params_scan", "posterior_moments", "year_panel", "impact_factor", "stride_probabilities",
    "nearest_threshold_year", "forecast_path", "horizon_summary", "year_join_with_fallback", "milestones",
    "features_pipeline", "chronological_split_ceil", "cache_fresh_filter", "bars_store_roundtrip",
    "topic_prompts", "topic_batch_enrich", "landscape_defaults", "report_metrics", "r2_score", "bars_stream_append",
    "cache_cover", "cache_gaps", "cache_fallback", "ewma_gaps", "ticks_rolling", "integrated_distribution", "integrated_quantiles",
    "integrated_probabilities", "parameter_sweep", "monte_carlo_quantiles", "expanding_folds", "resumable_enrich", "require_nonempty",
    "bars_csv_roundtrip", "bars_default_range", "feature_vector", "summary_json_sink", "analysis_json_sink", "landscape_with_client",
]


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF001)


def test_every_query_has_sql_or_is_a_forest():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = {name for name, q in load_registry().items() if q.sql is None}
    assert rows_only == {"rf_train", "rf_predict", "rf_evaluate", "feature_importance_topk", "forecast_job", "forecast_job_summary"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    q = Query(name, entry.queries()[name], entry.oracle_sql()[name])
    r = compare(spark, con, q, SF001)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 407
    assert "ma200" in df.columns
