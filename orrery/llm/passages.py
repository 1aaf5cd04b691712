"""Substring dedup by a count-min prefilter: of every passage the document with the smallest id
keeps it.

Every partition counts its windows' anchors in a count-min sketch; the sketches are merged by adding
cells.  A window has no more occurrences than its anchor, and an anchor no more than any of its
cells, so the merged sketch overestimates and a window estimated once is left out for certain.  A
second pass groups the windows estimated repeated exactly.  The sketch is a table of its non-empty
cells spread over the cluster, so its width grows with nothing in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from . import anchors
from .runs import LOC, check_width, completed, named, occurrences, once, per_row, run_table, with_text

WINDOW_WORDS, GRAM_WORDS = 50, 16
SKETCH_ROWS, SKETCH_BITS = 2, 40  # rows of the sketch, and the logarithm of their width


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends."""
    words = text.encode().split()
    data = b" ".join(words)
    if not words:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return data, np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))


def _measure(window: int, gram: int):
    def run(text: str):
        data, starts, ends = words_of(text)
        hashes = anchors.word_hashes(np.frombuffer(data, np.uint8), starts, ends) if len(starts) >= window else np.zeros(0, np.uint64)
        h, first, last = anchors.runs(anchors.word_grams(hashes, gram), window - gram + 1)
        return len(starts), data, h, first, last, starts[first], ends[last + window - 1] if len(h) else first

    return run


def _cell(row: int) -> str:
    """A sketch cell: row number and place in the row."""
    return f"shiftleft(xxhash64(h, {row}) & {(1 << SKETCH_BITS) - 1}L, 8) + {row}"


def merged_sketch(occ: DataFrame) -> DataFrame:
    """(cell, n): the sum of all partitions' sketches, non-empty cells only."""
    cells = occ.select(F.explode(F.expr(f"array({', '.join(_cell(r) for r in range(SKETCH_ROWS))})")).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n"))


def estimated_repeated(occ: DataFrame) -> DataFrame:
    """The runs whose anchor is estimated at two or more by every row of the merged sketch."""
    # written, so that the joins have two plain exchanges and can split a frequent anchor
    often = write_through(merged_sketch(occ).where("n > 1").select("cell"), "passage-cells")
    for row in range(SKETCH_ROWS):
        mine = often.where(f"cell & 255 = {row}").withColumnRenamed("cell", f"c{row}")
        occ = occ.withColumn(f"c{row}", F.expr(_cell(row))).join(mine, f"c{row}", "left_semi").drop(f"c{row}")
    return occ


def _digests(window: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "k", "w1", "w2", "at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for row in range(batch.num_rows):
                doc, k, text, found = (batch.column(c)[row].as_py() for c in range(4))
                data, starts, ends = words_of(text)
                at = np.unique(np.concatenate([np.arange(f["loc"] // LOC, f["loc"] // LOC + f["loc"] % LOC + 1) for f in found]))
                pair = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at + window - 1].tolist())]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), k)), pa.array(np.ascontiguousarray(pair[:, 0])),
                                                  pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(at)], schema=schema)

    return run


def _covered(n: int, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [first, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                doc, k, text, found = (batch.column(c)[row].as_py() for c in range(4))
                words = text.encode().split()
                loc = np.array([f["loc"] for f in found])
                gone = _covered(len(words), loc // LOC, loc // LOC + loc % LOC + window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc, k, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW_WORDS,
                    gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row: each word is removed that a window
    covers whose words also start in a row with a smaller id.

    Windows are judged on the input.  A run whose whole content stands in a row with a smaller id goes
    as a whole; windows are grouped one by one (by a 128-bit hash of their words) only for the first
    row of each distinct run, and only where its anchor has other runs.  A null text counts as
    empty; null ids are never smaller, and rows with null ids keep everything; repeated rows keep or
    lose alike; extra columns are not read; an empty table gives no rows.  ``window`` is at least ``gram``.
    """
    check_width("window", window, gram)
    rows = named(docs, id_column, text_column)
    table = run_table(rows, _measure(window, gram), "passage-runs")
    rows = once(rows, table)
    found = write_through(estimated_repeated(occurrences(table).where("doc_id IS NOT NULL")), "passage-candidates")
    distinct = write_through(found.groupBy("h", "rd").agg(F.min("doc_id").alias("low")), "passage-distinct")
    shared = write_through(distinct.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "passage-anchors")
    placed = found.join(distinct, ["h", "rd"])
    whole = placed.where("doc_id > low").select("doc_id", "k", "loc")
    first = placed.where("doc_id = low").join(shared, "h", "left_semi")
    windows = write_through(with_text(rows, per_row(first, "loc")).mapInArrow(
        _digests(window), "doc_id long, k long, w1 long, w2 long, at long"), "passage-windows")
    lows = write_through(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(
        "low < high").drop("high"), "passage-firsts")
    late = windows.join(lows, ["w1", "w2"]).where("doc_id > low").select("doc_id", "k", (F.col("at") * LOC).alias("loc"))
    removed = with_text(rows, per_row(whole.unionByName(late), "loc")).mapInArrow(
        _remove(window), "doc_id long, k long, removed long, kept string")
    return completed(table, removed, {"n_words": F.col("size"), "n_removed": F.coalesce("removed", F.lit(0)),
                                      "kept_sha256": F.coalesce("kept", "sha256")})
