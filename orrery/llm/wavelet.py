"""Token files: one wavelet matrix per shard, read without the original ids.

A shard holds the ids of consecutive documents as bit-planes, highest bit first; each plane is in
the order left by stably parting the ids by the planes above it, and carries counts of set bits per
block.  Access, counting and occurrence lookup work on the planes alone.  Ids are renumbered by
their order inside the shard, so a shard has as many planes as its own alphabet needs.

Shards are rows of Parquet files, because only Spark's writers reach every shared store.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .tokens import VOCABULARY, encoder

END_ID = 2
SHARD_TOKENS = 2_000_000
BLOCK = 512  # bits between two stored counts
STEP = 4096  # places that are led up at once

SHARD = "shard long, n_tokens long, n_docs long, alphabet binary, zeros binary, planes array<binary>, counts array<binary>, doc_ids binary, null_ids binary, lengths binary"


class WaveletMatrix:
    """``planes`` are packed bits, ``counts`` the set bits before each block, ``zeros`` the unset
    bits of each plane, ``alphabet`` the shard's ids ascending."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: list, counts: list):
        self.n, self.alphabet, self.zeros = n, alphabet, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.counts = [np.frombuffer(c, "<u4") for c in counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids) == 0:
            return cls(0, np.zeros(0, "<u4"), np.zeros(0, "<i8"), [], [])
        seen = np.flatnonzero(np.bincount(ids))
        renumber = np.zeros(int(seen[-1]) + 1, np.uint32)
        renumber[seen] = np.arange(len(seen))
        kind = np.uint16 if len(seen) <= 1 << 16 else np.uint32
        order, planes, counts, zeros = renumber.astype(kind)[ids], [], [], []
        for bit in reversed(range(max(1, int(len(seen) - 1).bit_length()))):
            ones = (order & kind(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            counts.append(cls._count(packed))
            # by places: faster than by a mask where bits change often
            set_, unset = np.flatnonzero(ones), np.flatnonzero(~ones)
            order = np.concatenate((order[unset], order[set_]))
            zeros.append(len(unset))
        return cls(len(ids), seen.astype("<u4"), np.array(zeros, "<i8"), planes, counts)

    @staticmethod
    def _count(packed: np.ndarray) -> np.ndarray:
        blocks = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        blocks[: len(packed)] = packed
        per_block = np.bitwise_count(blocks.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(per_block))).astype("<u4")

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each of the places ``at``."""
        at = np.asarray(at, np.int64)
        plane, blocks = self.planes[level], at // BLOCK
        inside = at - blocks * BLOCK
        window = (blocks * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
        bytes_ = np.where(window < len(plane), plane[np.minimum(window, len(plane) - 1)], 0).astype(np.uint8)
        left = np.clip(inside[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)
        masks = ((1 << left) - 1).astype(np.uint8)
        return self.counts[level][blocks].astype(np.int64) + np.bitwise_count(bytes_ & masks).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at places ``at``."""
        at = np.asarray(at, np.int64)
        code = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._rank1(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            code = 2 * code + bit
        return self.alphabet[code]

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in [start, end) lie below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = (int(x) for x in self._rank1(level, np.array([start, end])))
            one = code >> (len(self.zeros) - 1 - level) & 1
            start, end = (int(zeros) + a, int(zeros) + b) if one else (start - a, end - b)
        return start, end

    def rank(self, token: int, end: int, start: int = 0) -> int:
        """Occurrences of ``token`` in [start, end)."""
        if self.n == 0:
            return 0
        a, b = self._span(token, start, end)
        return b - a

    def _select(self, level: int, one: int, k: np.ndarray) -> np.ndarray:
        """The places of the ``k``-th (from 0) set or unset bits of a plane: the block by a binary search in
        the stored counts, the place by the bits of that block alone."""
        counts = self.counts[level].astype(np.int64)
        if not one:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = np.searchsorted(counts, k, side="right") - 1
        plane = self.planes[level]
        window = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
        bytes_ = np.where(window < len(plane), plane[np.minimum(window, len(plane) - 1)], 0).astype(np.uint8)
        bits = np.unpackbits(bytes_, axis=1, bitorder="little")
        upto = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int16)
        return block * BLOCK + (upto <= (k - counts[block])[:, None]).sum(axis=1)

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places of the first plane from places below the last, of one token."""
        code = int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.zeros))):
            one = code >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, one, at - (int(self.zeros[level]) if one else 0))
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending: its span below the last plane, led back up by select."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        a, b = self._span(token, 0, self.n)
        parts = [self._up(token, np.arange(at, min(at + STEP, b))) for at in range(a, b, STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0); -1 where there are fewer."""
        if self.n == 0:
            return -1
        a, b = self._span(token, 0, self.n)
        return int(self._up(token, np.array([a + k]))[0]) if 0 <= k < b - a else -1

    def decode(self) -> np.ndarray:
        """All ids in order, each plane's parting undone from the last to the first."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for k, level in enumerate(reversed(range(len(self.zeros)))):
            ones, zeros = self._bits(level), int(self.zeros[level])
            codes[zeros:] |= kind(1 << k)
            above = np.empty_like(codes)
            above[np.flatnonzero(~ones)] = codes[:zeros]
            above[np.flatnonzero(ones)] = codes[zeros:]
            codes = above
        return self.alphabet[codes]


def _shard_row(shard: int, ids: list[bytes], docs: list) -> dict:
    lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
    return {
        "shard": shard, "n_tokens": matrix.n, "n_docs": len(ids), "alphabet": matrix.alphabet.tobytes(),
        "zeros": matrix.zeros.tobytes(), "planes": [p.tobytes() for p in matrix.planes], "counts": [c.tobytes() for c in matrix.counts],
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
        "null_ids": np.array([d is None for d in docs], np.uint8).tobytes(), "lengths": lengths.astype("<i8").tobytes(),
    }


def _write_shards(vocabulary: str, end_id: int, shard_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        k, ids, docs, size = 0, [], [], 0
        schema = None
        for batch in batches:
            schema = _arrow_schema()
            encode = encoder(vocabulary).encode
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                encoded = encode(part.column(1).to_pylist())
                for doc, x in zip(part.column(0).to_pylist(), encoded):
                    ids.append(x + end)
                    docs.append(doc)
                    size += len(x) // 4 + 1
                    if size >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard_row(first + k, ids, docs)], schema=schema)
                        k, ids, docs, size = k + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard_row(first + k, ids, docs)], schema=schema)

    return run


def _arrow_schema() -> pa.Schema:
    b = pa.binary()
    return pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("alphabet", b), ("zeros", b),
                      ("planes", pa.list_(b)), ("counts", pa.list_(b)), ("doc_ids", b), ("null_ids", b), ("lengths", b)])


def write_tokens(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
                 vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode every whole text (null counts as empty), close each with ``end_id`` and write shards in
    ascending id order (null ids first; equal ids by a hash of their text) to a new folder ``path``,
    by default one in the shared folder.  Returns the folder.

    Documents are dealt by ranges of their ids; a task holds one shard of about ``shard_tokens`` ids
    and one text at a time.  Extra columns are not read.  An empty table gives a folder without shards.
    """
    path = path or scratch_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                       F.xxhash64(text_column).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = ordered.mapInArrow(_write_shards(vocabulary, end_id, shard_tokens), SHARD)
    shards.write.option("compression", "zstd").parquet(path)
    return path


def matrix_of(row) -> WaveletMatrix:
    """The wavelet matrix of a shard row."""
    return WaveletMatrix(row["n_tokens"], np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["zeros"], "<i8"),
                         row["planes"], row["counts"])


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.ascontiguousarray(matrix_of(row).decode(), "<u4").tobytes()
            lengths = np.frombuffer(row["lengths"], "<i8")
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            crcs = [zlib.crc32(ids[4 * a: 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())]
            doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64()),
                                              pa.array(np.full(len(lengths), row["shard"]))],
                                             names=["doc_id", "at", "n_tokens", "ids_crc32", "shard"])


def shard_offsets(spark, path: str) -> DataFrame:
    """(shard, before): the ids of all shards before each.

    Sums in two levels: over the shards of a writing task, and over the tasks, which are one row each."""
    shards = spark.read.schema(SHARD).parquet(path).select("shard", "n_tokens", F.shiftright("shard", 24).alias("task"))
    up_to = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = shards.select("shard", "task", F.coalesce(F.sum("n_tokens").over(up_to.partitionBy("task")), F.lit(0)).alias("inside"))
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    return inside.join(tasks, "task").select("shard", (F.col("above") + F.col("inside")).alias("before"))


def read_docs(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the shards alone.

    ``start`` adds the sizes of all shards before to the place inside; the offsets are joined by shard,
    broadcast only if their size at run time is small enough.  A folder without shards gives no rows."""
    docs = spark.read.schema(SHARD).parquet(path).mapInArrow(_read_docs, "doc_id long, at long, n_tokens long, ids_crc32 long, shard long")
    return docs.join(shard_offsets(spark, path), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _per_shard(spark, path: str, schema: str, rows_of):
    """``rows_of(matrix, shard)`` over all shards, one matrix in memory at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = rows_of(matrix_of(row), row["shard"])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    return spark.read.schema(SHARD).parquet(path).mapInArrow(run, schema)


def token_counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """Occurrences of each of ``tokens`` per shard (shard, token, n), by rank on the planes.  Repeated
    tokens are counted each; no shards, no rows."""
    def rows_of(m, shard):
        return np.full(len(tokens), shard), tokens, [m.rank(t, m.n) for t in tokens]

    return _per_shard(spark, path, "shard long, token long, n long", rows_of)


def token_places(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token, place): every occurrence of each of ``tokens`` in the whole sequence of ids, by select on the
    planes; tokens that occur nowhere have no row."""
    def rows_of(m, shard):
        found = [m.occurrences(t) for t in tokens]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return np.full(len(at), shard), np.repeat(np.array(tokens, np.int64), [len(x) for x in found]), at

    found = _per_shard(spark, path, "shard long, token long, at long", rows_of)
    return found.join(shard_offsets(spark, path), "shard").select("token", (F.col("before") + F.col("at")).alias("place"))


def tokens_at(spark, path: str, places: list[int]) -> DataFrame:
    """(place, token) for the ``places`` of the whole sequence of ids that exist, by access on the planes of
    the shards that hold them.  Repeated places give a row each."""
    wanted = spark.createDataFrame([(int(p),) for p in places], "place long")
    shards = spark.read.schema(SHARD).parquet(path)
    ends = shards.select("shard", "n_tokens").join(shard_offsets(spark, path), "shard")
    # the places are the caller's list; a place meets the one shard around it
    held = ends.join(F.broadcast(wanted), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n_tokens")))
    asked = held.groupBy("shard").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("before")).alias("at"))).alias("asked"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = matrix_of(row).access([a["at"] for a in row["asked"]])
                yield pa.RecordBatch.from_arrays([pa.array([a["place"] for a in row["asked"]], pa.int64()), pa.array(ids.astype(np.int64))], names=["place", "token"])

    return shards.join(F.broadcast(asked), "shard").mapInArrow(run, "place long, token long")  # no more than the places asked for
