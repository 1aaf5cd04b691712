"""Arrival model on the reference surveys: golden values (FIXTURES.md C2, C3)."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import arrival as A
from orrery.sources import scenarios as SC

GOLDEN = {
    2024: (0.842241, 2046.110805, 10.193219, [2033, 2039, 2046, 2053, 2059], [2034, 2047]),
    2025: (0.838714, 2046.697530, 10.441673, [2033, 2040, 2047, 2054, 2060], [2034, 2047]),
    2026: (0.833417, 2047.320408, 10.675198, [2034, 2040, 2047, 2055, 2061], [2034, 2048]),
}


@pytest.mark.parametrize("base", [2024, 2025, 2026])
def test_posterior_and_thresholds(spark, base):
    post = A.posterior_moments(SC.reference_surveys(spark), SC.reference_params(spark, base))
    p = post.collect()[0]
    integral, mean, std, nearest, first = GOLDEN[base]
    assert round(p.integral, 6) == integral
    assert round(p.posterior_mean, 6) == pytest.approx(mean, abs=1e-6)
    assert round(p.posterior_std, 6) == pytest.approx(std, abs=1e-6)
    curve = A.year_probabilities(post, 0, 40)
    got = [r.year for r in A.nearest_threshold_year(curve).orderBy("threshold").collect()]
    assert got == nearest
    got = [r.year for r in A.first_crossing_year(curve).orderBy("threshold").collect()]
    assert got == first


def test_growth_lognormal(spark):
    g = A.growth_lognormal(SC.reference_params(spark, 2025)).collect()[0]
    assert g.mean_years == pytest.approx(35.105163, abs=1e-6)
    assert g.shape == pytest.approx(0.293560, abs=1e-6)
    assert g.log_scale == pytest.approx(3.515259, abs=1e-6)


def test_impact_factors_depend_on_supplied_years(spark):
    post = A.posterior_moments(SC.reference_surveys(spark), SC.reference_params(spark, 2025))
    i20 = [round(r.stock_impact_factor, 6) for r in A.impact_factor(A.year_probabilities(post, 0, 20)).orderBy("year").collect()][:6]
    i3 = [round(r.stock_impact_factor, 6) for r in A.impact_factor(A.year_probabilities(post, 0, 3)).orderBy("year").collect()]
    assert i20 == [0.017650, 0.021594, 0.026209, 0.031559, 0.037705, 0.044699]
    assert i3 == [0.013934, 0.013699, 0.012239]
    yp = A.year_probabilities(post, 0, 6).orderBy("year").collect()
    assert [round(r.yearly_probability, 6) for r in yp] == [0.018856, 0.004872, 0.005890, 0.007055, 0.008374, 0.009849]


def test_density_integrates_to_one_and_cdf_increases(spark):
    grid = A.posterior_grid(A.density_grid(SC.reference_surveys(spark), SC.reference_params(spark, 2025)))
    g = grid.select("i", "x", "density").toPandas().sort_values("i")
    area = ((g.x.diff()) * (g.density + g.density.shift()) / 2).sum()
    assert area == pytest.approx(1.0, abs=1e-12)
    post = A.posterior_moments(SC.reference_surveys(spark), SC.reference_params(spark, 2025))
    p = [r.cumulative_probability for r in A.year_probabilities(post, 0, 40).orderBy("year").collect()]
    assert all(b > a for a, b in zip(p, p[1:]))


def test_normal_cdf_text_matches_erfc(spark):
    from orrery.functions.stats import normal_cdf_sql

    df = spark.range(-900, 901).select((F.col("id") / 100.0).alias("z"))
    rows = df.select("z", F.expr(normal_cdf_sql("z")).alias("p")).collect()
    err = max(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) for r in rows)
    assert err < 1e-15


def test_scenario_inputs_written_once_equal_direct(spark):
    """The written-through statistics give the same surveys and parameters as
    direct derivation, and the arrival chain then reads lineitem no more."""
    from paths import SF001

    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    direct = [SC.surveys_from_lineitem(li), SC.params_from_lineitem(li, 2025)]
    cut = SC.scenario_inputs(li, 2025)
    for a, b in zip(direct, cut):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    post = A.posterior_moments(*cut)
    assert "lineitem" not in post._jdf.queryExecution().optimizedPlan().toString()
    assert post.count() == direct[1].count()
