"""Best-fit packing of whole documents, with every partition's count of sequences certified.

Pieces are dealt to bounded slots by a hash and packed best-fit decreasing.  Dual-feasible
functions give a lower bound of the sequences any packing of that slot needs; where packing and
bound agree the slot is certified.  The documents of slots with a gap, and those of every slot's
emptiest sequence, are exchanged: dealt anew and packed again, and the new packing is taken when it
needs fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .tokens import VOCABULARY, encoder

CAPACITY, END_ID = 2048, 0
SLOT_PIECES = 16384  # pieces packed together in one task
ROUNDS = 3  # packings at most, the first included

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", slot long, bin long, offset long, loose boolean, slot_sequences long, slot_bound long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of two families of dual-feasible functions.

    Such a function maps lengths to shares of a sequence so that whatever fits together keeps a
    sum of at most one; the rounded-up sum over all pieces is then a bound."""
    if len(lengths) == 0:
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = int(-(-(counts * sizes).sum() // capacity))
    for cut in np.flatnonzero(counts[: capacity // 2 + 1]):  # drop below cut, round up above capacity - cut
        mapped = np.where(sizes > capacity - cut, capacity, np.where(sizes >= cut, sizes, 0))
        best = max(best, int(-(-(counts * mapped).sum() // capacity)))
    for k in range(1, 33):  # rounding to k-ths; exact multiples of 1 / (k + 1) keep their size
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of 1 / (k * (k + 1))
        mapped = np.where(whole, k * (scaled // capacity), (k + 1) * (scaled // capacity))
        best = max(best, int(-(-(counts * mapped).sum() // (k * (k + 1)))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per piece its sequence and offset.  The pieces must come longest first; each goes to the
    fullest sequence that still takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some sequence has r tokens left
    for k, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            bin_, room, n = n, capacity, n + 1
        bins[k], offsets[k] = bin_, capacity - room
        if room > length:
            by_room[room - length].append(bin_)
            rooms |= 1 << (room - length)
    return bins, offsets


def _pieces(vocabulary: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            encode = encoder(vocabulary).encode
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        out.append((row, doc, k, a, b - a, zlib.crc32(ids[4 * a: 4 * b])))
                        row += 1
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids with ``end_id``, cut from the end into pieces of ``capacity``, so only
    the first piece may be shorter; written once to the shared folder, each with a number ``row``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return write_through(rows.mapInArrow(_pieces(vocabulary, capacity, end_id), PIECE), "pieces")


def _pack_slot(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        bound = lower_bound(lengths, capacity)
        emptiest = np.argmin(np.bincount(bins, weights=lengths))
        return pdf.assign(bin=bins, offset=offsets, loose=(n != bound) | (bins == emptiest), slot_sequences=n, slot_bound=bound)

    return run


def _packed(rows: DataFrame, n: int, salt: int, capacity: int) -> DataFrame:
    slots = -(-n // SLOT_PIECES)
    dealt = rows.select("row", "doc_id", "piece", "start", "length", "ids_crc32",
                        F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(slots)).alias("slot"))
    return write_through(dealt.groupBy("slot").applyInPandas(_pack_slot(capacity), PLACED), "packed")


def _bins(placed: DataFrame) -> int:
    return placed.groupBy("slot").agg((F.max("bin") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece, and slot_sequences,
    slot_bound, certified: how many sequences the piece's slot was packed into, how many any packing
    needs, and whether the two agree.

    Pieces of ``capacity`` are sequences of their own.  A null or empty text is one piece that holds
    the end id; null ids are kept; repeated rows are packed each; extra columns are not read; an
    empty table gives no rows.  Between rounds only counts reach the driver.
    """
    cut = pieces(docs, id_column, text_column, vocabulary, capacity, end_id)
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("slot_sequences"), F.lit(1).cast("long").alias("slot_bound"))
    pool = cut.where(F.col("length") < capacity)
    n, settled = pool.count(), []
    placed = _packed(pool, n, 0, capacity) if n else None
    for salt in range(1, ROUNDS + 1):
        if placed is None:
            break
        loose = placed.where("loose")
        n = loose.count() if salt < ROUNDS else 0
        again = _packed(loose, n, salt, capacity) if n else None
        # the sequences whose documents were exchanged, against those that now hold them
        if again is None or _bins(again) >= loose.select("slot", "bin").distinct().count():
            settled.append((salt, placed))
            break
        settled.append((salt, placed.where("NOT loose")))
        placed = again
    out = full
    for salt, done in settled:
        out = out.unionByName(done.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.expr(f"shiftleft(CAST({salt} AS BIGINT), 56) + shiftleft(slot, 24) + bin").alias("sequence_id"), "offset", "slot_sequences", "slot_bound"))
    return out.withColumn("certified", F.col("slot_sequences") == F.col("slot_bound"))
