"""Exact k-means of integer vectors by progressive search in the Walsh-Hadamard domain.

The transform of a vector adds and subtracts its components only, so it is exact in whole numbers, and
squared distances come out times the number of components.  Its coefficients run from coarse to
fine; a centroid's sum of squared differences so far and the norms of what is left bound
its distance from both sides.  A centroid whose lower bound exceeds another's upper bound is strictly
worse and is left; the others go on, and whoever is left after all coefficients is compared exactly.

Vectors stay transformed through all rounds: a cluster's sum of coefficients gives its sum of
components back.  Every round sends the centroids out and brings one sum per cluster and component back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through

SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
STEPS = (4, 16, 64)  # coefficients read by the end of each step, of 64; other sizes in proportion


def walsh_matrix(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by their number of sign changes: coarse to fine."""
    if size < 1 or size & (size - 1):
        raise ValueError("the number of dimensions must be a power of two")
    m = np.ones((1, 1), np.int64)
    while len(m) < size:
        m = np.block([[m, m], [m, -m]])
    return m[np.argsort((np.diff(m, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """Coefficients of each row of ``x``."""
    return x @ walsh_matrix(x.shape[1]).T


def _root(x: np.ndarray) -> np.ndarray:
    """A whole number at most sqrt(x), short of it by at most 3."""
    return np.maximum(np.floor(np.sqrt(x.astype(np.float64))).astype(np.int64) - (x > 0), 0)


def assign(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of coefficients ``v`` the nearest row of ``c`` (ties: the smaller number) and the squared
    distance, both exact.  Coefficients must lie within 2**26, so that all sums fit 64 bits."""
    n, size = v.shape
    rows, cents = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(len(c)), indexing="ij"))
    sums = np.zeros(len(rows), np.int64)
    read = 0
    for step in STEPS:
        to = size * step // STEPS[-1]
        difference = v[rows, read:to] - c[cents, read:to]
        sums += np.einsum("ij,ij->i", difference, difference)
        read = to
        if read == size:
            break
        root_v, root_c = _root((v[:, read:] ** 2).sum(axis=1))[rows], _root((c[:, read:] ** 2).sum(axis=1))[cents]
        lower = sums + np.maximum(np.maximum(root_v - root_c, root_c - root_v) - 3, 0) ** 2
        upper = sums + (root_v + root_c + 6) ** 2
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, rows, upper)
        left = lower <= least[rows]
        rows, cents, sums = rows[left], cents[left], sums[left]
    order = np.lexsort((cents, sums, rows))
    first = order[np.concatenate(([True], rows[order[1:]] != rows[order[:-1]]))] if n else order
    return cents[first], sums[first] // size


def _coefficients(dimensions: int, scale: int):
    limit = 2**26 // dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimensions)
            if np.abs(x).max() >= limit:
                raise ValueError(f"components beyond {limit / scale} are not supported: distances would leave 64 bits")
            flat = transformed(x.astype(np.int64)).ravel().astype(np.int32)
            offsets = np.arange(0, len(flat) + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["vec_id", "v"])

    return run


def coefficients(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS,
                 scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the transform of floor(scale * x), written once.  Vectors that are null, of another
    length, or hold a null or non-finite component take no part."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    usable = F.expr(f"size(x) = {dimensions} AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    return write_through(rows.where(usable).mapInArrow(_coefficients(dimensions, scale), "vec_id long, v array<int>"), "walsh")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(centroids: np.ndarray):
    """Per task one row for each cluster and coefficient: how many vectors, and their sum."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                cluster, _ = assign(v, centroids)
                counts += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, v)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                np.repeat(np.arange(k), size), np.tile(np.arange(size), k), np.repeat(counts, size), sums.ravel())], names=["cluster", "at", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = assign(_matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    return run


def k_means(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS, each: Callable | None = None) -> np.ndarray:
    """The coefficients of the final centroids of (vec_id, v) rows after ``rounds`` rounds from ``start``.

    A centroid becomes its vectors' componentwise floor(sum / count); one without vectors stays.  Per
    round the driver receives clusters times dimensions rows.  ``each(round, centroids)`` is told of every round."""
    centroids, size = start, start.shape[1]
    walsh = walsh_matrix(size)
    for number in range(rounds):
        parts = vectors.mapInArrow(_sums(centroids), "cluster long, at long, n long, total long")
        # decimal sums: exact however many rows there are
        totals = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        sums, counts = [[0] * size for _ in start], [0] * len(start)
        for r in totals:
            counts[r["cluster"]], sums[r["cluster"]][r["at"]] = r["n"], int(r["total"])
        new = centroids.copy()
        for c, n in enumerate(counts):
            if n:  # the matrix has orthogonal rows: its transpose undoes it, but for a factor
                components = np.array(sums[c], object) @ walsh.astype(object)
                new[c] = transformed(np.array([[int(x) // size // n for x in components]], np.int64))[0]
        if each is not None:
            each(number, new)
        if (new == centroids).all():
            break  # a fixed point: further rounds change nothing
        centroids = new
    return centroids


def components(centroids: np.ndarray) -> np.ndarray:
    """Centroids back from their coefficients."""
    return centroids @ walsh_matrix(centroids.shape[1]) // centroids.shape[1]


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding",
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid (array)
    for every vector that takes part.

    Centroids start as the ``clusters`` vectors with the smallest sha256 of ``seed:id``, fewer where there
    are fewer; equal hashes (repeated ids, null ids, which count as an empty string) go by the
    vectors' coefficients.  Ties in distance go to the smaller number.  Extra columns are not read.  A table
    without usable vectors gives no rows.
    """
    vectors = coefficients(table, id_column, vector_column, dimensions, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    spark = table.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                     "centroid_sha256 string, centroid array<long>")
    centroids = k_means(vectors, np.array([r["v"] for r in first], np.int64), rounds)
    final = [[int(x) for x in row] for row in components(centroids)]
    named = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row) for k, row in enumerate(final)],
                                  "cluster int, centroid_sha256 string, centroid array<long>")
    assigned = write_through(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "walsh-assigned")
    by_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row per cluster on the right: at most ``clusters``
    of = named.join(by_cluster, "cluster", "left").select("*", F.expr("sum(cluster_inertia) OVER ()").alias("inertia"))
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
