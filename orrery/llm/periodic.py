"""Maximal periodic runs of words, by uniting suffix classes from the longest common prefix down.

The suffixes of a text that share a prefix of some length are a class.  Neighbours in the sorted
suffixes are united by decreasing common prefix (the edges of a maximum spanning tree, taken as
Kruskal takes them), with union-find, and every class keeps its positions in order.  Two positions that become
neighbours in a class at a distance within the common prefix lie one smallest period apart in a run;
the run ends where their common prefix ends, and the first such position of a period and an end
is where it starts.

Why that is complete: let a run start at s and have period q and a length of at least 2q.  s and
s + q share length - q words, at least q.  A position between them that shared as many words with s
would give the run a second, smaller period over at least the sum of both, hence one that divides q.  So
the two are neighbours when their class forms.  Why no seed has a wrong period: a smaller one would
put a third position of the class between the two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = "struct<start: long, length: long, period: long>"


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words, up to where all differ; a zero beyond the end."""
    n = len(ids)
    levels, step = [np.append(ids + 1, 0)], 1
    while step < n and len(levels[-1]) > 1:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:n]
        distinct, new = np.unique(rank[:n] * (n + 2) + after, return_inverse=True)
        levels.append(np.append(new + 1, 0))
        step *= 2
        if len(distinct) == n:
            break
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (different positions)."""
    a, b = a.copy(), b.copy()
    n, out = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        out += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return out


def _repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` words may stand elsewhere too, by a hash: a few too many, none too few."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    key = x[:n].copy()
    for k in range(1, width):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + x[k: k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n, bool)
    again[1:] |= same
    again[:-1] |= same
    return np.sort(order[again])


def find_runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A run's words ``period`` apart are identical, the period is the smallest such, the length is at least
    ``min_length`` and ``min_exponent`` (2 or more) times the period, and no neighbouring word extends it."""
    if min_exponent < 2:
        raise ValueError("min_exponent must be at least 2")
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # the common prefix of a run's first two periods: length - period
    least = max(1, min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1)))
    if len(numbers) == len(words):
        return []
    candidates = _repeated(ids, least)
    if not len(candidates):
        return []
    levels = _ranks(ids)
    order = candidates[np.argsort(levels[-1][candidates], kind="stable")]
    common = _common(levels, order[:-1], order[1:])
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent = list(range(len(order)))
    classes: list[list[int] | None] = [[p] for p in order.tolist()]
    starts: dict[tuple[int, int], int] = {}  # (period, end) of a run: its first position so far

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for edge, shared in zip(edges.tolist(), common[edges].tolist()):
        a, b = root(edge), root(edge + 1)
        large, small = classes[a], classes[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], classes[b] = a, None
        for k, p in enumerate(small):  # ascending, so the neighbour before p is final
            at = bisect_left(large, p)
            if at:
                before = large[at - 1]
                if p - before <= shared and (not k or before != small[k - 1]):
                    key = (p - before, p + shared)
                    if starts.get(key, p) > before:
                        starts[key] = before
            if at < len(large):
                after = large[at]
                if after - p <= shared and (k + 1 == len(small) or small[k + 1] > after):
                    key = (after - p, after + shared)
                    if starts.get(key, after) > p:
                        starts[key] = p
            large.insert(at, p)
    return sorted((s, e - s, q) for (q, e), s in starts.items() if e - s >= max(min_length, min_exponent * q))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def repeat_tail(doc_id: int | None, words: list) -> list:
    """Plants a run in every tenth document by the crc32 of its id: words from one place on repeat with
    a period there.  A document without an id stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    again = words[first: first + period]
    return words[:first] + (again * -(-(n - first) // period))[: n - first]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT, rewrite: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the kept words
    joined by one space) for every row; ``rewrite(id, words)`` may change a row's words first.

    Words are what white space of ASCII separates.  A null or empty text has no words, no runs and
    an empty collapsed text; null ids are kept; repeated rows are judged each; extra columns are not
    read; an empty table gives no rows.  A text is worked on whole, in memory of its own size.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = (text or "").encode().split()
                    if rewrite is not None:
                        words = rewrite(doc, words)
                    runs = find_runs(words, min_length, min_exponent)
                    kept = kept_words(words, runs) if runs else words
                    out.append((doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def run_report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (greatest exact length / period; ties: smallest start, then
    period; nulls without a run), exponent_milli, runs_sha256 and collapsed_sha256 of ``periodic_runs``."""
    # a run beats the best so far by length / period, compared as whole numbers; runs come by start, then period
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start: long, length: long, period: long>), (best, r) ->
        CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
