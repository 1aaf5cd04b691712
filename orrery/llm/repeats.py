"""Suffix-array dedup: every byte that a repeated string of minimum length covers.

Texts are cut into runs of windows that share an anchor; equal windows are always in runs of equal
anchors.  Equal runs are one text with a multiplicity.  Runs of one anchor with different contents
meet in one task (beyond HOT of them their windows are grouped by hash instead), which sorts the suffixes of the joined texts, forms their Burrows-Wheeler
transform and expands intervals breadth-first: an interval of all suffixes that start with some
string is extended backward by each character before it, so common prefixes are found by increasing
length.  The expansion stops at the minimum length; neighbours whose common prefix is still unknown
then share at least that much.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from . import anchors
from .passages import _covered
from .runs import LOC, check_width, completed, named, occurrences, once, packed, per_row, run_table, unpacked, with_text

MINIMUM = 200  # bytes
GRAM_PARTS = 4  # 16-byte grams that make an anchor's gram
CHUNK_BYTES = 1 << 21  # bytes whose suffixes are sorted at once, unless one anchor's runs are more
HOT = 2000  # different runs of one anchor beyond which their windows are grouped one by one
START = 8  # common prefixes below this length are read off the first sort's keys
SEPARATOR = 0xFF  # in no UTF-8 text


def suffix_order(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` (uint8) in the order of their first ``least`` or more bytes, and the
    first 8 bytes of each as a big-endian number, in that order."""
    n = len(data)
    padded = np.concatenate((data, np.full(8, SEPARATOR, np.uint8)))
    keys = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(keys)
    rank = np.empty(n, np.int64)
    sorted_ = keys[order]
    first = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
    rank[order] = first
    length, bits = 8, max(1, int(n).bit_length())
    times = max(2, min(4, 62 // bits))  # how many ranks one number holds
    while length < least and first[-1] < n - 1:
        keys2 = rank.copy()
        for k in range(1, times):
            keys2 <<= bits
            step = k * length
            keys2[: n - step] |= rank[step:] + 1 if step < n else 0
        order = np.argsort(keys2)
        sorted2 = keys2[order]
        first = np.concatenate(([0], np.cumsum(sorted2[1:] != sorted2[:-1])))
        rank[order] = first
        length *= times
    return order, keys[order]


def shares_prefix(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, known): the suffixes in order, and for each place whether its common prefix with the
    suffix before it was found to be shorter than ``least``."""
    order, keys = suffix_order(data, least)
    n = len(data)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = np.where(order > 0, order - 1, n - 1)
    back = inverse[before]  # where the suffix one character longer stands
    letter = data[before]  # the Burrows-Wheeler transform
    forth = np.empty(n, np.int64)
    forth[back] = np.arange(n)
    # the next and the last place with the same letter; "back" keeps the order inside a letter
    after = np.full(n, n, np.int64)
    prior = np.full(n, -1, np.int64)
    same = letter[forth[1:]] == letter[forth[:-1]]
    after[forth[:-1][same]] = forth[1:][same]
    prior[forth[1:][same]] = forth[:-1][same]

    known = np.ones(n + 1, bool)  # boundaries in front of places; both ends are known
    known[1:n] = keys[1:] != keys[:-1]
    bounds = np.flatnonzero(known)
    lows, highs = bounds[:-1], bounds[1:]  # the intervals of all strings of START bytes
    for _ in range(START, least):
        if not len(lows):
            break
        sizes = highs - lows
        owner = np.repeat(np.arange(len(lows)), sizes)
        places = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lows[owner]
        inside = letter[places] != SEPARATOR  # no string that is looked for holds one
        places, owner = places[inside], owner[inside]
        last = after[places] >= highs[owner]
        first = prior[places] < lows[owner]
        # an interval has one first and one last place per letter; "back" brings both in the same order
        low, high = (back[places[m]][np.argsort(owner[m] * np.int64(n) + back[places[m]])] for m in (first, last))
        high += 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        lows, highs = low, high
    return order, known[:n]


def repeated_starts(texts: list[bytes], windows: list[int], least: int = MINIMUM) -> list[np.ndarray]:
    """Per text which of its first ``windows`` places start a string of ``least`` bytes that starts at
    another such place too.  Every such place must have ``least`` bytes behind it in its text."""
    # separators beyond the end keep the order of the last suffixes in step with their predecessors'
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts) + b"\xff" * (2 * least), np.uint8)
    order, known = shares_prefix(data, least)
    # a place shares its string with a neighbour in order
    hit = ~known
    hit[:-1] |= ~known[1:]
    repeated = np.zeros(len(data), bool)
    repeated[order] = hit
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return [repeated[s: s + w] for s, w in zip(starts.tolist(), windows)]


def _measure(least: int, parts: int):
    def run(text: str):
        data = text.encode()
        grams = anchors.byte_grams(np.frombuffer(data, np.uint8))
        n = max(0, len(grams) - 16 * (parts - 1))
        joined = grams[:n].copy()
        for k in range(1, parts):
            joined = joined * anchors._M1 + grams[16 * k: 16 * k + n]
        h, first, last = anchors.runs(anchors.mixed(joined), least - 16 * parts + 1)
        return len(data), data, h, first, last, first, last + least

    return run


def _texts(least: int, hot: int):
    """The bytes of the named runs; for runs of hot anchors a 128-bit hash of each of their windows."""
    schema = pa.schema([("h", pa.int64()), ("rd", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("windows", pa.int64()),
                        ("data", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, pair = xxhash.xxh3_128_digest, struct.Struct("<qq").unpack
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                data = unpacked(batch.column(2)[row].as_py())
                for f in batch.column(3)[row].as_py():
                    first, windows = f["loc"] // LOC, f["loc"] % LOC + 1
                    if f["c"] <= hot:
                        out.append((f["h"], f["rd"], f["n"], 0, windows, data[first: first + windows - 1 + least], None, None))
                    else:
                        out += [(f["h"], f["rd"], f["n"], at, 1, None, *pair(digest(data[first + at: first + at + least]))) for at in range(windows)]
                    if len(out) > 4096:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    return run


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """h, rd, a, len: the stretches of ``windows`` (h, rd, n, at, w1, w2) that stand anywhere else too.
    Counted map-side, so no task meets all places of a window."""
    twice = write_through(windows.groupBy("w1", "w2").agg(
        F.max("n").alias("n"), F.min("rd").alias("r0"), F.max("rd").alias("r1"), F.min("at").alias("a0"), F.max("at").alias("a1")).where(
        "n > 1 OR r0 < r1 OR a0 < a1").select("w1", "w2"), "repeat-windows")
    places = windows.select("h", "rd", "at", "w1", "w2").join(twice, ["w1", "w2"], "left_semi").groupBy("h", "rd").agg(
        F.sort_array(F.collect_set("at")).alias("s"))  # at most as many as a run has windows
    return places.selectExpr("h", "rd", "filter(s, (x, i) -> coalesce(get(s, i - 1) < x - 1, true)) AS a",
                             "filter(s, (x, i) -> coalesce(get(s, i + 1) > x + 1, true)) AS z").selectExpr(
        "h", "rd", "inline(arrays_zip(a, z))").selectExpr("h", "rd", "a", "z - a + 1 AS len")


def _expand(least: int):
    schema = pa.schema([("h", pa.int64()), ("rd", pa.int64()), ("a", pa.int64()), ("len", pa.int64())])

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (h, rd, n, windows, data), whole groups of h."""
        hits = repeated_starts([r[4] for r in rows], [r[3] for r in rows], least)
        out = []
        for r, hit in zip(rows, hits):
            if r[2] > 1:  # the run itself stands in several places
                hit = np.ones(r[3], bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
            out += [(r[0], r[1], int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != group:
                    group = row[0]
                    if size >= CHUNK_BYTES:
                        out, held, size = solve(held), [], 0
                        if out is not None:
                            yield out
                held.append(row)
                size += len(row[4]) + 1
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _remove(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                data = np.frombuffer(unpacked(batch.column(2)[row].as_py()), np.uint8)
                found = batch.column(3)[row].values
                a, n = (found.field(x).to_numpy() for x in ("a", "len"))
                gone = _covered(len(data), a, a + n - 1 + least)
                spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                out.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), int(gone.sum()), spans,
                            hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = MINIMUM,
                   parts: int = GRAM_PARTS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row: each byte is removed that is
    covered by a string of ``least`` bytes which also starts anywhere else in the corpus.

    Strings are judged on the input.  A null text counts as empty; ids may be null; repeated rows are
    places of their own, so all their strings of that length go; extra columns are not read; an
    empty table gives no rows.  ``least`` is at least an anchor's 16 * ``parts`` bytes.
    """
    check_width("least", least, 16 * parts)
    rows = named(docs, id_column, text_column)
    table = run_table(rows, _measure(least, parts), "repeat-runs")
    texts_once = packed(once(rows, table))
    occ = occurrences(table)
    # written, so that the join has two plain exchanges and can split a frequent anchor
    often = write_through(occ.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-anchors")
    found = write_through(occ.join(often, "h", "left_semi"), "repeat-candidates")
    distinct = write_through(found.groupBy("h", "rd").agg(
        F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("k").alias("k"), F.first("loc").alias("loc")), "repeat-distinct")
    per_anchor = distinct.groupBy("h").agg(F.count("*").alias("c"))
    contents = distinct.join(per_anchor, "h")
    meeting = contents.where("c > 1").select("doc_id", "k", "h", "rd", "n", "loc", "c")
    texts = write_through(with_text(texts_once, per_row(meeting, "h", "rd", "n", "loc", "c")).mapInArrow(
        _texts(least, hot), "h long, rd long, n long, at long, windows long, data binary, w1 long, w2 long"), "repeat-texts")
    dealt = texts.where("w1 IS NULL").select("h", "rd", "n", "windows", "data").repartition("h").sortWithinPartitions("h")
    expanded = dealt.mapInArrow(_expand(least), "h long, rd long, a long, len long")
    single = _repeated_windows(texts.where("w1 IS NOT NULL"))
    alone = contents.where("c = 1 AND n > 1").select("h", "rd", F.lit(0).cast("long").alias("a"), (F.col("loc") % LOC + 1).alias("len"))
    spans = write_through(expanded.unionByName(single).unionByName(alone), "repeat-spans")
    hits = found.join(spans, ["h", "rd"]).select("doc_id", "k", (F.floor(F.col("loc") / LOC) + F.col("a")).alias("a"), "len")
    removed = with_text(texts_once, per_row(hits, "a", "len")).mapInArrow(_remove(least), "doc_id long, k long, removed long, spans long, kept string")
    return completed(table, removed, {"n_bytes": F.col("size"), "n_removed": F.coalesce("removed", F.lit(0)),
                                      "n_spans": F.coalesce("spans", F.lit(0)), "kept_sha256": F.coalesce("kept", "sha256")})
