"""Exact top-k inner products by no-random-access aggregation.

Every block of candidates keeps, per dimension, its values in sorted order.  A block of queries
reads those lists from their favourable ends, deeper in each round.  What has been read, and the
frontier of what has not, bound every candidate's score from below and above.  A query is done
reading when no outsider's upper bound reaches its k-th lower bound; the final scores of the few
left are then resolved.  Blocks of queries meet blocks of candidates; the best of all blocks are
merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
# Rows of a block.  A candidate is shuffled once for every query block, so that one is large, 8 MB of 64
# components; its queries are answered in steps.
CANDIDATE_BLOCK, QUERY_BLOCK, QUERY_STEP = 1024, 16_384, 1024
DEPTHS = (0.25, 0.5, 1.0)  # shares of the lists that are read by the end of each round
FEW = 4  # reading ends when at most FEW * k candidates may still be among the best


def _kind(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest number kind that holds every partial sum exactly."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def top_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of every query's best ``k`` rows of ``x``, not counting rows with its own id.
    Ties go to smaller ids."""
    kind = _kind(x, q)
    x, q = x.astype(kind), q.astype(kind)
    n, k = len(x), min(k, len(x))
    ascending = np.argsort(x, axis=0, kind="stable")
    dims = np.arange(x.shape[1])
    low, high = x[ascending[0], dims], x[ascending[-1], dims]
    # what the two ends have shown: the value where it was read, else a bound
    top_up, top_low = np.tile(high, (n, 1)), np.tile(low, (n, 1))
    end_up, end_low = top_low.copy(), top_up.copy()
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    active, read, out = np.arange(len(q)), 0, []
    for depth in DEPTHS:
        to = max(min(n, k + 1), int(np.ceil(depth * n)))
        at = ascending[n - to: n - read], ascending[read:to]
        top_up = np.minimum(top_up, x[ascending[n - to], dims])  # the frontier bounds all that is unread
        end_up = np.maximum(end_up, x[ascending[to - 1], dims])
        for rows, up, lower in ((at[0], top_up, top_low), (at[1], end_up, end_low)):
            lower[rows, dims] = x[rows, dims]
        top_up, end_up = np.maximum(top_up, top_low), np.minimum(end_up, end_low)
        read = to
        upper = positive[active] @ top_up.T + negative[active] @ end_up.T
        lower_bound = upper if to == n else positive[active] @ top_low.T + negative[active] @ end_low.T
        own = query_ids[active][:, None] == ids[None, :]
        lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        lower_bound = np.where(own, lowest, lower_bound)
        limit = np.partition(lower_bound, n - k, axis=1)[:, n - k]
        open_ = (upper >= limit[:, None]) & ~own
        counts = open_.sum(axis=1)
        done = np.ones(len(active), bool) if to == n else counts <= FEW * k
        for row in np.flatnonzero(done):
            left = np.flatnonzero(open_[row])
            scores = x[left] @ q[active[row]]
            best = np.lexsort((ids[left], -scores))[:k]
            out += [(int(query_ids[active[row]]), int(ids[left[b]]), int(scores[b])) for b in best]
        active = active[~done]
        if not len(active):
            break
    return out


def quantised(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component.  Rows whose vector or id is null, whose vector is
    empty or holds a null or non-finite component take no part."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.expr("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return rows.where(finite).select("id", F.expr(f"transform(v, x -> CAST(floor({scale}D * x) AS BIGINT))").alias("v"))


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding",
            scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row whose id is
    divisible by ``every`` with all rows of other ids; fewer where there are fewer.

    Vectors meet only vectors of their own length.  Repeated rows of an id are candidates each and
    one query, by the least of their vectors.  Extra columns are not read.  An empty table gives no rows.  Sums beyond 2**63 are not
    supported.
    """
    rows = quantised(table, id_column, vector_column, scale).withColumn("d", F.size("v"))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n, m = (t.agg(F.count("*")).head()[0] for t in (rows, queries))
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    # by the row's place too, so that copies of one row do not share a block
    salted = rows.withColumn("b", F.expr(f"pmod(xxhash64(id, monotonically_increasing_id()), {blocks})"))
    left = salted.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("q", F.expr(f"CAST(pmod(xxhash64(id), {query_blocks}) AS INT)")).withColumn(
        "b", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def vectors(t: pa.Table) -> np.ndarray:
        flat = pa.concat_arrays([c.flatten() for c in t["v"].chunks]).to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1)

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, x, query_ids, q = candidates["id"].to_numpy(), vectors(candidates), asked["id"].to_numpy(), vectors(asked)
        found = [f for at in range(0, len(q), QUERY_STEP) for f in top_of_block(ids, x, query_ids[at: at + QUERY_STEP], q[at: at + QUERY_STEP], k)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], schema=schema)

    found = left.groupBy("d", "b", "q").cogroup(right.groupBy("d", "b", "q")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
