"""Forecast path: closed form equals the running product of step factors; summary rules."""

import datetime as dt

import numpy as np
import pytest

from orrery.operators import forecast as G


def _prices(last_close, steps, block_rates):
    """Price after each step by the definition: from step 30 on every step grows by the 30th root of
    its 30-step block's growth factor; the product of all factors so far scales the last close."""
    step = np.arange(steps)
    factors = np.where(step < 30, 1.0, (1.0 + np.array([block_rates[b] for b in step // 30])) ** (1 / 30))
    return last_close * np.cumprod(factors)


def test_closed_form_equals_running_product(spark):
    start = spark.createDataFrame(
        [("S", "base", dt.date(2024, 11, 20), 100.0, 0.01)],
        "symbol string, scenario_id string, bar_date date, close double, predicted_return double",
    )
    impact = spark.createDataFrame(
        [("base", 2024, 0.02, 0.1), ("base", 2025, 0.03, 0.2)],
        "scenario_id string, year int, stock_impact_factor double, agi_probability double",
    )
    days = 400
    path = G.forecast_path(start, impact, days).orderBy("step").collect()
    assert len(path) == days
    rates = {}
    for b in range(0, days // 30 + 1):
        year = (dt.date(2024, 11, 21) + dt.timedelta(days=30 * b)).year
        factor = {2024: 0.02, 2025: 0.03}.get(year, 0.03)  # later years fall back to the last row
        rates[b] = 0.01 * (1 + factor)
    want = _prices(100.0, days, rates)
    for r, w in zip(path, want):
        assert r.forecasted_close == pytest.approx(w, rel=1e-12)
    assert all(r.forecasted_close == 100.0 for r in path[:30])
    assert path[0].forecast_date == dt.date(2024, 11, 21)
    # by hand: step 30 is one step into the first growing block, step 59 its last, step 60 one further
    grown = 100.0 * (1 + rates[1])
    assert path[30].forecasted_close == pytest.approx(100.0 * (1 + rates[1]) ** (1 / 30), rel=1e-12)
    assert path[59].forecasted_close == pytest.approx(grown, rel=1e-12)
    assert path[60].forecasted_close == pytest.approx(grown * (1 + rates[2]) ** (1 / 30), rel=1e-12)


def test_fallback_uses_last_row_for_earlier_years(spark):
    rows = spark.createDataFrame([("base", 1999), ("base", 2026), ("base", 2031)], "scenario_id string, block_year int")
    impact = spark.createDataFrame(
        [("base", 2025, 0.1, 0.5), ("base", 2026, 0.2, 0.6), ("base", 2027, 0.3, 0.7)],
        "scenario_id string, year int, stock_impact_factor double, agi_probability double",
    )
    got = {r.block_year: r.impact_factor for r in G.year_join_with_fallback(rows, impact).collect()}
    assert got == {1999: 0.3, 2026: 0.2, 2031: 0.3}


def test_summary_skips_horizon_equal_to_length(spark):
    start = spark.createDataFrame(
        [("S", "base", dt.date(2024, 1, 1), 50.0, 0.0)],
        "symbol string, scenario_id string, bar_date date, close double, predicted_return double",
    )
    impact = spark.createDataFrame([("base", 2024, 0.0, 0.0)], "scenario_id string, year int, stock_impact_factor double, agi_probability double")
    s = G.horizon_summary(G.forecast_path(start, impact, 365), start, 365).collect()[0]
    assert s["1_month_price"] == 50.0 and s["3_months_return_pct"] == 0.0
    assert s["1_year_price"] is None and s["1_year_return_pct"] is None
    m = G.milestones(G.forecast_path(start, impact, 365), 365).collect()
    assert sorted(r.step for r in m) == [90, 180]


def test_forecast_outputs_read_their_inputs_once(spark):
    """Orders three times (bars, their counts, the plan of scenarios), line items once beside the statistics."""
    import __spark_entry__ as entry

    for name in ("report_metrics", "horizon_summary", "forecast_path"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("orders.parquet]") <= 3 and plan.count("lineitem.parquet]") == 1, (name, plan)
