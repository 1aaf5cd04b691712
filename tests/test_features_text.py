"""Splits, feature drops, text enrichment rules."""

import datetime as dt

from pyspark.sql import functions as F

from orrery.operators import enrich as E
from orrery.operators import features as FE


def _series(spark, n, sym="S"):
    rows = [(sym, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar_date date, x double")


def test_split_rules_follow_float_products(spark):
    # ceil(n * 0.2) test rows vs the first floor(n * 0.8) train rows: equal in
    # exact arithmetic (n - floor(0.8 n) = ceil(0.2 n)); both are float products
    df = _series(spark, 11).unionByName(_series(spark, 10, "T"))
    ceil = FE.with_split(df, rule="ceil").groupBy("symbol").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert {r.symbol: r.t for r in ceil} == {"S": 3, "T": 2}
    floor = FE.with_split(df, rule="floor").groupBy("symbol").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert {r.symbol: r.t for r in floor} == {"S": 3, "T": 2}
    first_test = {r.symbol: r.d for r in FE.with_split(df, rule="ceil").filter("is_test")
                  .groupBy("symbol").agg(F.min("bar_date").alias("d")).collect()}
    assert first_test == {"S": dt.date(2020, 1, 9), "T": dt.date(2020, 1, 9)}


def test_split_test_rows_are_the_latest(spark):
    df = _series(spark, 50)
    pdf = FE.with_split(df, rule="ceil").toPandas().sort_values("bar_date")
    assert pdf.is_test.tolist() == [False] * 40 + [True] * 10


def test_topic_prompts_rules(spark):
    prompts = spark.createDataFrame([("a", "hello"), ("b", "x" * 20)], "topic string, prompt string")
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")

    def client(p):
        if len(p) > 10:
            raise ValueError("too long")
        return p.upper()

    got = {r.topic: r.response for r in E.topic_prompts(req, prompts, client).collect()}
    assert got == {"a": "HELLO", "b": "Error analyzing b: too long", "c": "Unknown topic: c"}
    none = {r.response for r in E.topic_prompts(req, prompts, None).collect()}
    assert none == {E.NO_CLIENT}


def test_batch_enrich_captures_errors_per_row(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "boom")], "topic string, prompt string")

    def client(p):
        if p == "boom":
            raise RuntimeError("failed")
        return "fine"

    got = {r.topic: r.response for r in E.topic_batch_enrich(df, client).collect()}
    assert got == {"a": "fine", "b": "Error: failed"}


def test_a_task_holds_few_texts_at_once(spark):
    """Of a batch of long prompts only a few are Python texts at a time: what was asked before is free again."""
    def make():
        import gc

        def client(prompt):
            return str(sum(isinstance(x, list) and len(x) > 0 and isinstance(x[0], str) and len(x[0]) == 999 and len(x) or 0
                           for x in gc.get_objects()))
        return client

    df = spark.range(300, numPartitions=1).selectExpr("CAST(id AS STRING) AS topic", "repeat('x', 999) AS prompt", "id AS n")
    out = E.topic_batch_enrich(df, factory=make)
    rows = out.collect()
    assert out.columns == ["topic", "prompt", "n", "response"] and sorted(r.n for r in rows) == list(range(300))
    assert all(r.topic == str(r.n) and r.prompt == "x" * 999 and int(r.response) <= E.ROWS_AT_ONCE for r in rows)
    assert "MapInPandas" not in out._jdf.queryExecution().toString()


def test_client_is_built_by_its_factory_in_the_task(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "yy")], "topic string, prompt string")
    got = {r.topic: r.response for r in E.topic_prompts(df.select("topic"), df, factory=lambda: lambda p: p * 2).collect()}
    assert got == {"a": "xx", "b": "yyyy"}


def test_forest_size_is_bounded_by_fit_rows(spark):
    from orrery.operators import model as M

    sizes = []
    for n in (2000, 8000):
        df = spark.range(n).select(F.rand(1).alias("x"), F.rand(2).alias(FE.TARGET))
        model = M.train_forest(df, ["x"], num_trees=3, max_depth=12, fit_rows=500, min_instances=5)
        sizes.append(model.stages[-1].totalNumNodes)
    assert max(sizes) < 3 * 2 * 600 / 5 and sizes[1] < 1.5 * sizes[0]
