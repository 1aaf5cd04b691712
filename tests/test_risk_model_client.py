"""Integrated distribution, sweep, simulation, folds, split, stored forest and the resumable client."""

import datetime as dt
import math
import os
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import arrival as A
from orrery.operators import enrich as E
from orrery.operators import features as FE
from orrery.operators import folds as FO
from orrery.operators import integrated as IN
from orrery.operators import model as M
from orrery.operators import simulate as MC
from orrery.plans.sequence import Series
from orrery.sources import scenarios as SC

S = Series("symbol", "bar_date")


def _reference(spark, base_year=2025):
    return SC.reference_surveys(spark), SC.reference_params(spark, base_year)


def test_integrated_distribution_inverts_itself(spark):
    grid = A.density_grid(*_reference(spark))
    dist = IN.integrated_distribution(grid)
    pdf = dist.orderBy("i").toPandas()
    assert pdf.cdf.iloc[0] == 0 and abs(pdf.cdf.iloc[-1] - 1) < 1e-12 and (np.diff(pdf.cdf) >= 0).all()
    density = grid.orderBy("i").toPandas()
    x, y = density.x.to_numpy(), density.combined.to_numpy()
    want = np.concatenate(([0], np.cumsum(np.diff(x) * (y[1:] + y[:-1]) / 2)))
    assert np.allclose(pdf.cdf, want / want[-1], atol=1e-13)
    quantiles = {r.percentile: r.year for r in IN.integrated_quantiles(dist).collect()}
    assert all(abs(q - np.interp(p, pdf.cdf, pdf.x)) < 1e-9 for p, q in quantiles.items()) and len(quantiles) == 7
    years = spark.createDataFrame([("base", y) for y in range(2020, 2070)], "scenario_id string, year int")
    probs = IN.integrated_probabilities(dist, years).orderBy("year").toPandas()
    assert np.allclose(probs.cumulative_probability, np.interp(probs.year, pdf.x, pdf.cdf, left=0, right=1), atol=1e-12)
    assert abs(probs.yearly_probability.sum() - 1) < 1e-12
    # the skewed, cut density is not the normal of its moments
    normal = A.with_cumulative(A.posterior_moments(*_reference(spark)).withColumn("year", F.lit(2030))).head().cumulative_probability
    assert abs(normal - probs[probs.year == 2030].cumulative_probability.iloc[0]) > 0.005


def test_sweep_equals_one_posterior_per_point(spark):
    surveys, params = _reference(spark)
    sweep = {(r.survey_weight, r.growth_factor): r for r in IN.parameter_sweep(surveys, params, (0.2, 0.5, 1.0), (1.0, 1.2)).collect()}
    assert len(sweep) == 6
    for (w, g), r in sweep.items():
        p = params.withColumns({"compute_growth_rate": F.col("compute_growth_rate") * g, "expert_weight": F.lit(w), "growth_weight": F.lit(1 - w)})
        one = A.posterior_moments(surveys, p).head()
        for name in ("integral", "posterior_mean", "posterior_std"):
            assert abs(r[name] - one[name]) < 1e-8, (w, g, name)


def _path(spark, days=40):
    rows = [(s, c, k, 100.0 * 1.001 ** (k + 1), 100.0) for s in ("a", "b") for c in ("x", "y") for k in range(days)]
    rows.append(("c", "x", 0, 5.0, 5.0))  # no volatility
    path = spark.createDataFrame(rows, "symbol string, scenario_id string, step int, forecasted_close double, last_close double")
    return path, spark.createDataFrame([("a", 0.02), ("b", 0.0), ("c", None)], "symbol string, volatility double")


def test_simulated_paths_do_not_depend_on_partitions(spark):
    path, vol = _path(spark)
    one = MC.simulate_paths(path, vol, 300, 7)
    rows = {(r.symbol, r.scenario_id, r.path, r.step): r.price for r in one.collect()}
    other = MC.simulate_paths(path.repartition(7, "step"), vol.repartition(3), 300, 7).repartition(5).collect()
    assert len(rows) == 4 * 300 * 40 == len(other)
    assert all(abs(rows[(r.symbol, r.scenario_id, r.path, r.step)] - r.price) < 1e-9 for r in other)
    assert all(abs(p - 100 * 1.001 ** (k[3] + 1)) < 1e-9 for k, p in rows.items() if k[0] == "b")  # no volatility, no spread
    moves = np.log([rows[("a", "x", p, 39)] / rows[("a", "x", p, 38)] for p in range(300)]) - math.log(1.001)
    assert abs(moves.mean()) < 3 * 0.02 / 300**0.5 and abs(moves.std() / 0.02 - 1) < 0.15
    assert MC.simulate_paths(path, vol, 300, 8).where("symbol = 'a' AND path = 0 AND step = 0").head().price != rows[("a", "x", 0, 0)]


def test_sketch_quantiles_merge_and_keep_their_error(spark):
    rng = np.random.default_rng(5)
    data = {"u": rng.lognormal(0, 2, 1501), "v": rng.uniform(1e-3, 1e4, 60), "w": np.array([3.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v]
    df = spark.createDataFrame(rows + [("w", None), ("w", 0.0)], "k string, x double")
    whole = MC.quantile_sketch(df, ["k"], "x")
    parts = [MC.quantile_sketch(d, ["k"], "x") for d in df.randomSplit([1.0, 2.0, 3.0], seed=1)]
    merged = MC.merge_sketches(*parts, keys=["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    for r in MC.sketch_quantiles(merged, ["k"], (0.01, 0.5, 0.9, 1.0)).collect():
        v = np.sort(data[r.k])
        exact = v[max(0, math.ceil(r["quantile"] * len(v) - 1e-9) - 1)]
        assert abs(r.value / exact - 1) <= MC.RELATIVE_ERROR * 1.001


def test_fold_scores_from_cells_equal_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), float(v)) for s, n in (("a", 400), ("b", 61), ("c", 4)) for k, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, y double")
    numbered = FO.numbered(df, S, block_rows=50).cache()
    for k, embargo in ((5, 30), (3, 0), (5, 200)):
        scores = {(r.symbol, r.fold): r for r in FO.mean_fold_scores(numbered, "y", k, embargo).collect()}
        want = 0
        for s, n in (("a", 400), ("b", 61), ("c", 4)):
            v = np.array([r[2] for r in rows if r[0] == s])
            for fold in range(1, k + 1):
                size = n // (k + 1)
                first = n - (k + 1 - fold) * size
                train, test = v[: max(0, first - embargo)], v[first: first + size]
                members = FO.fold_rows(numbered.where(F.col("symbol") == s), fold, k, embargo).groupBy("is_test").count().collect()
                assert {r.is_test: r["count"] for r in members} == {t: len(x) for t, x in ((True, test), (False, train)) if len(x)}
                if len(train) and len(test):
                    want += 1
                    r = scores[(s, fold)]
                    assert (r.n_train, r.n_test) == (len(train), len(test))
                    assert abs(r.mean_train - train.mean()) < 1e-12
                    if len(test) > 1:
                        assert abs(r.r2 - (1 - ((test - train.mean()) ** 2).sum() / ((test - test.mean()) ** 2).sum())) < 1e-9
        assert len(scores) == want


def _bars(spark, n=420):
    rng = np.random.default_rng(3)
    rows = []
    for symbol in ("p", "q"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(symbol, dt.date(2001, 1, 1) + dt.timedelta(days=k), float(c), float(c) + 1, float(c) - 1, float(c),
                  None if k % 50 == 7 and symbol == "q" else 10 + k) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume long")


@pytest.mark.parametrize("rule,embargo", [("ceil", 0), ("floor", 5)])
def test_split_on_the_features_layout_equals_the_general_one(spark, rule, embargo):
    bars = _bars(spark)
    general = FE.with_split(FE.features_pipeline(bars, None, S), S, 0.2, rule, embargo)
    own = FE.features_with_split(bars, S, 0.2, rule, embargo, block_rows=64)
    # no second layout: rows are dealt for the layout alone, and again in the branch that counts the blocks
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2, plan
    assert own.columns == general.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, general.collect())) and own.count() > 100
    assert "ReusedExchange" in own._jdf.queryExecution().executedPlan().toString()


def test_forest_is_fitted_once_and_again_for_changed_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a - b)) for a, b in x], "a double, b double, y double")
    fits = []
    fit = M.train_forest
    monkeypatch.setattr(M, "train_forest", lambda *a, **k: fits.append(1) or fit(*a, **k))
    settings = {"num_trees": 3, "max_depth": 4}
    folder = f"file://{tmp_path}/forests"
    first = M.stored_forest(df, ["a", "b"], "y", folder=folder, **settings)
    again = M.stored_forest(df.repartition(5).orderBy("b"), ["a", "b"], "y", folder=folder, **settings)
    assert len(fits) == 1 and first.stages[-1].toDebugString.split("\n", 1)[1] == again.stages[-1].toDebugString.split("\n", 1)[1]
    M.stored_forest(df.where("a < 2"), ["a", "b"], "y", folder=folder, **settings)
    assert len(fits) == 2
    M.stored_forest(df, ["a", "b"], "y", folder=folder, num_trees=4, max_depth=4)
    assert len(fits) == 3
    M.stored_forest(df.union(df.limit(1)), ["a", "b"], "y", folder=folder, **settings)  # one row twice
    assert len(fits) == 4
    assert not [p for p in pathlib.Path(tmp_path, "forests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def _client(calls, kill_at=None):
    """Writes down what it is asked; the worker dies at a certain prompt while ``kill_at`` exists."""
    def make():
        def client(prompts):
            with open(calls, "a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            if kill_at and os.path.exists(kill_at) and any(p.endswith("7") for p in prompts):
                os._exit(1)
            if any("bad" in p for p in prompts):
                raise ValueError("bad prompt")
            return [p.upper() for p in prompts]
        return client
    return make


def test_client_resumes_after_a_killed_task(spark, tmp_path):
    rows = [(f"t{k}", f"prompt {k}") for k in range(60)] + [("t0", "prompt 0"), ("null", None), (None, "nameless")]
    df = spark.createDataFrame(rows, "topic string, prompt string").repartition(4)
    store, calls, alive = f"file://{tmp_path}/store", str(tmp_path / "calls"), tmp_path / "kill"
    alive.touch()
    with pytest.raises(Exception):
        E.resumable_enrich(df, store, _client(calls, str(alive)), batch_size=4, rounds=10).collect()
    kept = {r.key: r.response for r in E.read_replies(spark, store).collect()}
    alive.unlink()
    first = open(calls).read().splitlines()
    os.truncate(calls, 0)
    out = E.resumable_enrich(df, store, _client(calls), batch_size=4, rounds=10).collect()
    second = open(calls).read().splitlines()
    # what the first run kept is not asked again, the rest once
    assert len(second) == 61 - len(kept) == len(set(second)) and not set(p.upper() for p in second) & set(kept.values())
    assert len(set(first) & set(second)) < 61 and len(out) == len(rows)
    assert all(r.response == (r.prompt.upper() if r.prompt else None) for r in out)
    os.truncate(calls, 0)
    E.resumable_enrich(df, store, _client(calls), rounds=10).collect()
    assert open(calls).read() == ""


def test_failed_prompts_are_kept_and_asked_again_on_request(spark, tmp_path):
    df = spark.createDataFrame([("a", "good"), ("b", "bad one"), ("c", "fine")], "topic string, prompt string").coalesce(1)
    store, calls = f"file://{tmp_path}/store", str(tmp_path / "calls")
    out = {r.topic: (r.response, r.ok) for r in E.resumable_enrich(df, store, _client(calls), rounds=1).collect()}
    assert out == {"a": ("GOOD", True), "b": ("Error: bad prompt", False), "c": ("FINE", True)}
    os.truncate(calls, 0)
    E.resumable_enrich(df, store, _client(calls), rounds=1).collect()
    assert open(calls).read() == ""
    E.resumable_enrich(df, store, _client(calls), rounds=1, retry_errors=True).collect()
    assert open(calls).read().splitlines()[0] == "bad one" and "good" not in open(calls).read()


def test_fit_rows_lie_in_few_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, data: seen.append((data.rdd.getNumPartitions(), data.count()))})())
    for parts in (3, 40):
        M.train_forest(spark.range(400).selectExpr("id * 1.0D AS a", "id * 2.0D AS y").repartition(parts), ["a"], "y")
    assert seen == [(3, 400), (M.FIT_PARTS, 400)]


def test_the_summary_fits_one_forest(spark, tmp_path, monkeypatch):
    from orrery.catalog.model import q_forecast_job_summary

    spark.range(320).selectExpr("id AS o_orderkey", "'p' AS o_orderpriority", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS o_orderdate",
                                "CAST(100 + pmod(id * 37, 11) AS DOUBLE) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(320).selectExpr("id AS l_orderkey", "pmod(id, 4) AS l_suppkey", "'A' AS l_returnflag", "'F' AS l_linestatus",
                                "CAST(pmod(id * 7, 50) AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    fits = []
    monkeypatch.setattr(M, "stored_forest", lambda train, cols: fits.append(1) or M.train_forest(train, cols, num_trees=2, max_depth=2))
    (row,) = q_forecast_job_summary(spark, str(tmp_path)).collect()
    assert fits == [1] and row.symbol == "p" and row.train_score is not None and row.test_score is not None


def test_every_labelled_row_fits_the_forest(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, data: seen.append((data.count(), data.agg({"y": "max"}).head()[0]))})())
    M.train_forest(spark.range(20000).selectExpr("id * 1.0D AS a", "id * 2.0D AS y"), ["a"], "y", num_trees=2)
    assert seen == [(20000, 39998.0)]


def test_bins_are_cut_by_all_rows(spark):
    # one row of 40,000 holds a value of its own, which a sample would miss
    df = spark.range(40000).selectExpr("CAST(id AS DOUBLE) AS a", "IF(id = 777, 2, pmod(id, 2)) AS k", "1.5D AS c", "IF(id % 2 = 0, 9, -id) AS t")
    cols = ["a", "k", "c", "t"]
    bins = M.bins_of(df, cols, dict(zip(cols, (40000, 3, 1, 20000))), 32)
    a, k, c, t = bins.getSplitsArray()
    assert k == [float("-inf"), 1, 2, float("inf")] and c == [float("-inf"), 0, float("inf")] and len(t) <= 33 and 9 in t
    assert len(a) == 33 and all(abs(got - at * 1250) < 100 for at, got in enumerate(a[1:-1], 1))
    rows = bins.transform(df).groupBy("k", "k_bin").count().collect()
    assert sorted((r.k, r.k_bin) for r in rows) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_a_large_forest_is_grown_and_kept_in_groups(spark, tmp_path, monkeypatch):
    df = spark.range(3000).selectExpr("id % 97 * 1.0D AS a", "id % 89 AS b", "sin(id % 97) + id % 89 AS y").repartition(5)
    monkeypatch.setattr(M, "TREE_ROWS", 18000)  # two trees to a group
    monkeypatch.setattr(M, "GROUPS_AT_ONCE", 3)
    counts = []
    fit = M.RandomForestRegressor.fit
    monkeypatch.setattr(M.RandomForestRegressor, "fit", lambda self, data: counts.append((self.getNumTrees(), self.getSeed(), data.count())) or fit(self, data))
    settings = {"num_trees": 15, "max_depth": 6, "min_instances": 5}
    whole = M.train_forest(df, ["a", "b"], "y", **settings)
    assert sorted(counts) == [(1, 49, 3000)] + [(2, 42 + k, 3000) for k in range(7)]
    forest = whole.stages[-1]
    assert forest.getNumTrees == 15 == forest.getOrDefault("numTrees") and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 15
    kept = M.stored_forest(df, ["a", "b"], "y", folder=f"file://{tmp_path}/forests", **settings)
    (name,) = [p for p in pathlib.Path(tmp_path, "forests").iterdir() if not p.name.startswith(".")]
    assert sorted(p.name for p in name.iterdir()) == [*map(str, range(8)), "features"]
    again = M.stored_forest(df, ["a", "b"], "y", folder=f"file://{tmp_path}/forests", **settings).stages[-1]
    assert kept.stages[-1].getNumTrees == 15 and kept.stages[-1].toDebugString == again.toDebugString
    out = M.predict(kept, df)
    assert out.columns == ["a", "b", "y", "prediction"] and M.r2_score(out, "y").head().r2 > 0.8


@pytest.fixture(scope="module")
def many_bars(spark, tmp_path_factory):
    """Two series of 3,500 days under one scenario: 3,271 - 655 training rows each."""
    at = tmp_path_factory.mktemp("bars")
    spark.range(7000).selectExpr("id AS o_orderkey", "concat('p', id % 2) AS o_orderpriority", "date_add(DATE'1990-01-01', CAST(id div 2 AS INT)) AS o_orderdate",
                                 "CAST(100 + pmod(id * 37, 11) AS DOUBLE) AS o_totalprice").write.parquet(f"{at}/orders.parquet")
    spark.range(320).selectExpr("id AS l_orderkey", "pmod(id, 4) AS l_suppkey", "'A' AS l_returnflag", "'F' AS l_linestatus",
                                "CAST(pmod(id * 7, 50) AS DOUBLE) AS l_quantity").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def _fitted_rows(spark, monkeypatch, tmp_path, bars, name):
    """The rows that the forest of a query is fitted on, and the query's rows."""
    from orrery.catalog import load_registry

    seen, small = [], M.RandomForestRegressor
    fit = small._fit
    monkeypatch.setattr(M, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(small, "_fit", lambda self, data: seen.append(data.count()) or fit(self.copy({self.numTrees: 2, self.maxDepth: 3}), data))
    return seen, load_registry()[name].run(spark, bars).collect()


def test_rf_train_fits_on_all_training_rows(spark, monkeypatch, tmp_path, many_bars):
    seen, rows = _fitted_rows(spark, monkeypatch, tmp_path, many_bars, "rf_train")
    assert seen and set(seen) == {2 * 2616} and len(rows) == 1


def test_rf_predict_uses_a_forest_of_all_training_rows(spark, monkeypatch, tmp_path, many_bars):
    seen, rows = _fitted_rows(spark, monkeypatch, tmp_path, many_bars, "rf_predict")
    assert seen and set(seen) == {2 * 2616} and [r.predicted_return is None for r in rows] == [False] * 2


def test_forecast_job_uses_a_forest_of_all_training_rows(spark, monkeypatch, tmp_path, many_bars):
    seen, rows = _fitted_rows(spark, monkeypatch, tmp_path, many_bars, "forecast_job")
    assert seen and set(seen) == {2 * 2616} and len(rows) == 2 * 365


def test_forecast_job_summary_uses_a_forest_of_all_training_rows(spark, monkeypatch, tmp_path, many_bars):
    seen, rows = _fitted_rows(spark, monkeypatch, tmp_path, many_bars, "forecast_job_summary")
    assert seen and set(seen) == {2 * 2616} and len(rows) == 2 and all(r.train_score is not None and r.test_score is not None for r in rows)
