"""Return model (M1-M4, A7, F3) with Spark ML.

One random forest over all series: rows are split chronologically *per
series* (W10) so no test row of any symbol is seen in training.  Spark's
forest bins features and caps depth at 30, so it will not equal
scikit-learn's tree for tree; results are judged by R^2 and row counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import scratch_path
from .features import TARGET

# The reference's forest settings (100 trees, seed 42, unlimited
# depth — Spark's limit is 30 — and every feature considered at each split).
NUM_TREES = 100
SEED = 42
MAX_DEPTH = 30

# A leaf holds so many rows or more.
MIN_INSTANCES = 10

# A small fit's rows are dealt to so many partitions, where they lie in more: each of them sends the statistics of every
# node of every tree through a shuffle.  So a larger fit's rows lie in as few partitions as hold PART_ROWS each.
FIT_PARTS = 8
PART_ROWS = 50_000

# Rows times trees that are grown at once: the driver holds the growing nodes of these alone.  A forest of more is grown in
# groups of trees, so many of them side by side.
TREE_ROWS = 250_000
GROUPS_AT_ONCE = 3

# The cuts between a feature's bins are within this share of all rows from their exact places (a sketch of every row).
CUT_ERROR = 0.001
BIN = "_bin"  # of a column that holds another's bins
FEATURES = "features"  # in a kept forest's folder, the stages before the groups of trees


def feature_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """assemble feature columns, in order, into one vector column."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def _size_mb(text: str) -> int:
    """``"16g"`` / ``"512m"`` / ``"1t"`` -> MiB (a plain number is bytes, as in Spark)."""
    t = text.strip().lower().rstrip("b")
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if t and t[-1] in units:
        return int(float(t[:-1]) * units[t[-1]])
    return int(float(t) / (1024 * 1024))


def node_budget_mb(spark: SparkSession) -> int:
    """Memory per pass for the forest's split statistics (``maxMemoryInMB``).

    Every running task allocates its own statistics buffers, so the budget is
    an eighth of the task JVM's memory (the driver in local mode, an executor
    on a cluster) divided by the tasks it runs at once, kept between 16 MiB and
    2 GiB.  It only decides how many nodes are grown per pass over the data,
    not which splits are chosen.
    """
    sc = spark.sparkContext
    conf = sc.getConf()
    master = conf.get("spark.master") or ""
    if master.startswith("local-cluster"):  # executors of their own: local-cluster[executors,cores,memory]
        mem, slots = conf.get("spark.executor.memory") or "1g", int(conf.get("spark.executor.cores") or master.split(",")[1])
    elif master.startswith("local"):
        mem, slots = conf.get("spark.driver.memory") or "1g", sc.defaultParallelism
    else:
        mem, slots = conf.get("spark.executor.memory") or "1g", int(conf.get("spark.executor.cores") or "1")
    return max(16, min(2048, _size_mb(mem) // (8 * max(1, slots))))


def bins_of(rows: DataFrame, cols: list[str], kinds: dict[str, int], max_bins: int) -> Bucketizer:
    """Columns as numbers of at most ``max_bins`` bins: one for each value where there are no more (``kinds`` has how
    many about), else of about equal size, cut by sketches of all rows (the forest's own cuts come from a sample of 10,000)."""
    few = [c for c in cols if kinds[c] <= max_bins]
    sets = rows.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(F.col(c).cast("double"))) for c in few]).head()[1:]
    at = {c: values for c, values in zip(few, sets) if len(values) <= max_bins}
    many = [c for c in cols if c not in at]
    at |= zip(many, rows.approxQuantile(many, [k / max_bins for k in range(max_bins)], CUT_ERROR) if many else [])
    cuts = [sorted({v for v in at[c] if at[c][0] < v < math.inf}) or [0.0] for c in cols]
    return Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=cols,
                      outputCols=[f"{c}{BIN}" for c in cols], handleInvalid="error")


def forest_of(like: RandomForestRegressionModel, trees: list) -> RandomForestRegressionModel:
    """A forest of these trees (JVM objects) with the features and settings of another."""
    sc, java = SparkContext._active_spark_context, like._java_obj
    ml = sc._jvm.org.apache.spark.ml
    held = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for k, tree in enumerate(trees):
        held[k] = tree
    forest = ml.regression.RandomForestRegressionModel(java.uid(), held, java.numFeatures())
    java.copyValues(forest, ml.param.ParamMap())
    forest.set("numTrees", len(trees))
    return RandomForestRegressionModel._from_java(forest)


def trees_of(forests: list[RandomForestRegressionModel]) -> list:
    return [tree for forest in forests for tree in forest._java_obj.trees()]


def kept_forest(folder: str, pieces: int) -> PipelineModel:
    """The forest that ``train_forest`` has put into ``folder``."""
    with ThreadPoolExecutor(GROUPS_AT_ONCE) as pool:
        forests = list(pool.map(lambda k: RandomForestRegressionModel.load(f"{folder}/{k}"), range(pieces)))
    return PipelineModel([*PipelineModel.load(f"{folder}/{FEATURES}").stages, forest_of(forests[0], trees_of(forests))])


def train_forest(train: DataFrame, cols: list[str], label: str = TARGET, *, num_trees: int = NUM_TREES,
                 max_depth: int = MAX_DEPTH, seed: int = SEED, max_bins: int = 32,
                 min_instances: int = MIN_INSTANCES, fit_rows: int | None = None,
                 max_memory_mb: int | None = None, folder: str | None = None) -> PipelineModel | None:
    """M1: fit ``Bucketizer -> VectorAssembler -> RandomForestRegressor`` on every labelled row.

    Only a caller that names ``fit_rows`` fits on about so many, taken by a hash of their values; no query does.
    A fit of more than TREE_ROWS grows its trees in groups, each on all rows with a seed of its own.  Given a ``folder``,
    every group is saved there when it is grown and leaves the driver (``kept_forest`` reads them).  The
    training frame is persisted (memory, spilling to disk) for the forest's repeated passes; a lost executor only recomputes its blocks.
    Node ids are cached next to the rows and a large per-pass node budget
    lets one pass grow many nodes of all trees at once: deep trees otherwise
    need one pass over the data per small group of nodes.
    """
    if max_memory_mb is None:
        max_memory_mb = node_budget_mb(train.sparkSession)

    def forest(trees: int, seed: int) -> RandomForestRegressor:
        return RandomForestRegressor(
            featuresCol="features", labelCol=label, predictionCol="prediction", numTrees=trees,
            maxDepth=max_depth, maxBins=max_bins, minInstancesPerNode=min_instances, seed=seed,
            featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True,
            cacheNodeIds=True, maxMemoryInMB=max_memory_mb, checkpointInterval=10,
        )

    rows = train.select(*cols, label)
    if fit_rows is not None:
        share = fit_rows / max(1, rows.count())
        rows = rows.where(F.pmod(F.xxhash64(*cols, label), F.lit(1 << 30)) / float(1 << 30) < share)
    held = [rows.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        n, *kinds = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in cols]).head()
        bins = bins_of(rows, cols, dict(zip(cols, kinds)), max_bins)
        va = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
        if n * num_trees <= TREE_ROWS:
            dealt = rows.repartition(FIT_PARTS) if rows.rdd.getNumPartitions() > FIT_PARTS else rows
            whole = Pipeline(stages=[bins, va, forest(num_trees, seed)]).fit(dealt)
            if folder is None:
                return whole
            PipelineModel(whole.stages[:-1]).save(f"{folder}/{FEATURES}")
            whole.stages[-1].save(f"{folder}/0")
            return None
        vectors = va.transform(bins.transform(rows)).select("features", label).repartition(math.ceil(n / PART_ROWS))
        held.append(vectors.persist(StorageLevel.MEMORY_AND_DISK))
        size = max(1, TREE_ROWS // (GROUPS_AT_ONCE * n))
        sizes = [min(size, num_trees - k) for k in range(0, num_trees, size)]

        def group(k: int) -> RandomForestRegressionModel | None:
            grown = forest(sizes[k], seed + k).fit(vectors)
            return grown if folder is None else grown.save(f"{folder}/{k}")

        with ThreadPoolExecutor(max(1, min(GROUPS_AT_ONCE, TREE_ROWS // (size * n)))) as pool:
            grown = list(pool.map(group, range(len(sizes))))
        if folder is None:
            return PipelineModel([bins, va, forest_of(grown[0], trees_of(grown))])
        PipelineModel([bins, va]).save(f"{folder}/{FEATURES}")
        return None
    finally:
        for frame in held:
            frame.unpersist()


def fingerprint(rows: DataFrame, cols: list[str], label: str, settings: dict) -> str:
    """A name for (rows, columns, settings): sums over row hashes, so that neither order nor
    partitioning matter and repeated rows count; one pass, partially aggregated."""
    h = F.xxhash64(*cols, label)
    mark = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).head()
    text = json.dumps([[str(v) for v in mark], cols, label, rows.select(*cols, label).schema.simpleString(), settings], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def stored_forest(train: DataFrame, cols: list[str], label: str = TARGET, *, folder: str | None = None, **settings) -> PipelineModel:
    """M1 kept: the forest of these rows and settings, fitted once and read from ``folder`` (by default in the
    session's shared folder) by everyone after.

    Changed rows, columns or settings have another fingerprint and are fitted anew.  A model is written in groups of trees
    under a name of its own and then renamed, so half-written ones are never read; of two that fit at
    the same time, the first to finish stays.
    """
    spark = train.sparkSession
    base = (folder or scratch_path(spark, "forests")).rstrip("/")
    jvm = spark._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = place(base).getFileSystem(spark._jsc.hadoopConfiguration())
    # The rows are written once: the fingerprint and the fit see the same, and every job of the fit has a short plan.
    kept = scratch_path(spark, f"fit-rows-{uuid.uuid4().hex}")
    train.select(*cols, label).write.parquet(kept)
    try:
        rows = spark.read.schema(train.select(*cols, label).schema).parquet(kept)
        name = fingerprint(rows, cols, label, {"groups": True} | settings)  # forests of before lie in one piece, fitted on a sample
        if not store.exists(place(f"{base}/{name}")):
            own = f"{base}/.{name}-{uuid.uuid4().hex}"
            train_forest(rows, cols, label, folder=own, **settings)
            if store.exists(place(f"{base}/{name}")) or not store.rename(place(own), place(f"{base}/{name}")):
                store.delete(place(own), True)
    finally:
        place(kept).getFileSystem(spark._jsc.hadoopConfiguration()).delete(place(kept), True)
    return kept_forest(f"{base}/{name}", len(store.listStatus(place(f"{base}/{name}"))) - 1)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M2: add ``prediction`` (the 30-row return) to every row."""
    out = model.transform(df)
    return out.drop("features", *(c for c in out.columns if c.endswith(BIN) and c not in df.columns))


def r2_score(df: DataFrame, label: str = TARGET, pred: str = "prediction", group: str | None = None) -> DataFrame:
    """``1 - sum((y - yhat)^2) / sum((y - mean y)^2)``, two passes (mean first,
    then the squared sums), optionally per group."""
    keys = [group] if group else []
    means = df.groupBy(*keys).agg(F.avg(label).alias("_ybar"))
    j = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))
    dev = F.col(label) - F.col("_ybar")
    res = F.col(label) - F.col(pred)
    return j.groupBy(*keys).agg((1 - F.sum(res * res) / F.sum(dev * dev)).alias("r2"))


def evaluate(model: PipelineModel, train: DataFrame, test: DataFrame, label: str = TARGET) -> DataFrame:
    """M3: R^2 on the training rows and on the held-out rows, one row."""
    tr = r2_score(predict(model, train), label).withColumnRenamed("r2", "train_score")
    te = r2_score(predict(model, test), label).withColumnRenamed("r2", "test_score")
    return tr.crossJoin(te)


def feature_importance_topk(spark: SparkSession, model: PipelineModel, cols: list[str], k: int = 10) -> DataFrame:
    """M4: the ``k`` largest feature importances, descending (the importance
    vector has one entry per feature, so it is small by construction)."""
    forest = model.stages[-1]
    imp = forest.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(cols, [float(v) for v in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def forest_summary(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """M1's model as data: trees, total nodes, features, depth limit."""
    forest = model.stages[-1]
    return spark.createDataFrame(
        [(forest.getNumTrees, int(forest.totalNumNodes), int(forest.numFeatures), int(forest.getOrDefault("maxDepth")))],
        "num_trees int, total_nodes int, num_features int, max_depth int",
    )
