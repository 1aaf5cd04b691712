"""Runs of windows as tables: the shared ground of the exact substring operators.

Every row of a corpus is named by its id and a hash of id and text.  Its windows are kept as runs
(see ``anchors``): the anchor's hash ``h``, a hash ``rd`` of all that the run spans, and ``loc``, the
first window times LOC plus the number of windows less one.  (h, rd) names the run's content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from . import anchors

LOC = anchors.MOST_WINDOWS  # more than the number of windows less one
NAMES = ["doc_id", "k"]


def check_width(what: str, length: int, gram: int) -> None:
    """Raises unless windows of ``length`` hold at least one gram and at most as many as a run has room for.  A run's
    windows all hold its anchor, so it never has more windows than a window has grams."""
    if not gram <= length < gram + anchors.MOST_WINDOWS:
        raise ValueError(f"{what} must lie between {gram} and {gram + anchors.MOST_WINDOWS - 1}")


def named(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, k, text); a null text counts as empty."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k"] == b["k"])


def run_table(rows: DataFrame, measure: Callable, name: str) -> DataFrame:
    """Per row of ``named`` rows: doc_id, k, size, sha256 (of the whole) and its runs, written once.

    ``measure(text)`` gives size, the bytes to be hashed as a whole, and arrays h, first, last and
    the byte bounds of each run in those bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()),
                              ("runs", pa.list_(pa.struct([("h", pa.int64()), ("rd", pa.int64()), ("loc", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, shas, counts, hs, rds, locs = [], [], [], [], [], []
                for text in part.column(2).to_pylist():
                    size, data, h, first, last, start, end = measure(text)
                    sizes.append(size)
                    shas.append(hashlib.sha256(data).hexdigest())
                    counts.append(len(h))
                    hs.append(h)
                    rds.append(np.array([digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())], np.uint64).view(np.int64))
                    locs.append(first * LOC + (last - first))
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (hs, rds, locs)], names=["h", "rd", "loc"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(shas), runs],
                                                 schema=schema)

    out = rows.mapInArrow(run, "doc_id long, k long, size long, sha256 string, runs array<struct<h: long, rd: long, loc: long>>")
    return write_through(out, name)


def occurrences(table: DataFrame) -> DataFrame:
    return table.select("doc_id", "k", F.inline("runs"))


def per_row(found: DataFrame, *columns: str) -> DataFrame:
    """The different ``columns`` of all rows with one name as a list ``found``: however often a row is
    repeated, never more than one text has runs (or windows, where ``found`` has single ones)."""
    return found.groupBy(*NAMES).agg(F.collect_set(F.struct(*columns)).alias("found"))


def once(rows: DataFrame, table: DataFrame) -> DataFrame:
    """One row per name of ``named`` rows, whose ``run_table`` is ``table``.  Only texts of repeated
    rows are brought together, and those map-side first."""
    again = write_through(table.groupBy(*NAMES).agg(F.count("*").alias("n")).where("n > 1").select(*NAMES), "repeated-rows")
    same = same_row(rows, again)
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(NAMES))


def with_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, k, text, found) for the rows named in ``found``."""
    return rows.join(found, same_row(rows, found)).select(rows["doc_id"], rows["k"], "text", "found")


def packed(rows: DataFrame) -> DataFrame:
    """``named`` rows with their whole texts as compressed UTF-8 bytes, so that a shuffle of them is
    about as small as the stored table."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [press(text.as_py().encode()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, k long, text binary")


def unpacked(text: bytes) -> bytes:
    """The UTF-8 bytes of a text of ``packed``."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(text)


def completed(table: DataFrame, changed: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """``table`` with ``changed``'s removals where a row has some; repeated rows share theirs."""
    once = changed.dropDuplicates(NAMES)
    return table.drop("runs").join(once, same_row(table, once), "left").select(table["doc_id"], *[c.alias(n) for n, c in extra.items()])
