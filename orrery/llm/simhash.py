"""SimHash near-duplicates by pigeonring filtering.

Fingerprints are linked at a few differing bits.  A fingerprint's 64 bits form a ring of
``threshold + 1`` segments.  If two fingerprints differ in at most ``threshold`` bits, some start on
the ring has, for every length l, a chain of l consecutive segments whose differences add up to at
most ``l * threshold / segments``.  So for some segment i they agree on it and differ in at most
``2 * threshold // segments`` bits of the next: entries under (i, segment i, segment i + 1), with the
next segment's single bits cleared as far as that budget goes, bring all such pairs together.  In
a bucket the longer chains prune pairs before the full distance is looked at.

Equal fingerprints are one from the start.  Large buckets are split into blocks that meet in pairs,
and a block keeps links that span its clusters, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import ROW, carried, carry

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
BLOCK_ENTRIES = 512  # entries of one bucket that a block may hold
CHUNK_ROWS = 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint: a bit is set if more than half of the shingles' XXH64 have it.
    Fewer words than a shingle has make one shingle; no word gives zero."""
    import xxhash

    found = (text or "").encode().lower().split()  # ASCII case and ASCII spaces only, as for bytes
    if not found:
        return 0
    joined = b" ".join(found)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest, n = xxhash.xxh64_digest, max(1, len(found) - words + 1)
    if n == 1:
        return int.from_bytes(digest(joined, seed), "big")
    spans = list(zip(starts, ends[words - 1:]))
    totals = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK_ROWS // 16):
        data = b"".join([digest(joined[a:b], seed) for a, b in spans[at: at + CHUNK_ROWS // 16]])
        totals += np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > n).tobytes(), "big")


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words, seed) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return run(text)


class Ring:
    """The segments of a fingerprint and the budgets of chains."""

    def __init__(self, threshold: int = MAX_BITS, bits: int = 64):
        self.m = threshold + 1
        base, more = divmod(bits, self.m)
        self.widths = [base + (k < more) for k in range(self.m)]
        self.shifts = [sum(self.widths[:k]) for k in range(self.m)]
        self.budgets = [length * threshold // self.m for length in range(1, self.m + 1)]

    def entries(self, fp: str) -> Column:
        """All entries of a fingerprint: (bucket, ring, exact), bucket the two segments from start ring.

        Of two fingerprints that differ in one bit of the second segment, the one that has the bit
        also stands where it would stand without it.  (Budget 1 holds for up to any threshold of 1
        or more, 0 for 0.)"""
        out = []
        for k in range(self.m):
            j = (k + 1) % self.m
            one, two = (f"(shiftrightunsigned({fp}, {self.shifts[x]}) & {(1 << self.widths[x]) - 1}L)" for x in (k, j))
            if self.m == 1:
                one, two = fp, "0L"
            bucket = f"shiftleft({one}, {self.widths[j] % 64}) | ({{}})"
            own = f"struct({bucket.format(two)} AS bucket, CAST({k} AS BIGINT) AS ring, true AS exact)"
            out.append(f"array({own})")
            if self.m > 1 and self.budgets[1] >= 1:
                out.append(f"""transform(filter(sequence(0, {self.widths[j] - 1}), b -> ({two} & shiftleft(1L, b)) <> 0),
                    b -> struct({bucket.format(f"{two} ^ shiftleft(1L, b)")} AS bucket, CAST({k} AS BIGINT) AS ring, false AS exact))""")
        return F.expr(f"inline(concat({', '.join(out)}))")

    def linked(self, differences: np.ndarray, ring: np.ndarray | int) -> np.ndarray:
        """Which differences (xor of two fingerprints) keep every chain budget from start ``ring``;
        the last chain is the whole ring, so that is also the full check."""
        ok = np.ones(len(differences), bool)
        total = np.zeros(len(differences), np.int64)
        ring = np.broadcast_to(ring, differences.shape)
        widths, shifts = np.array(self.widths, np.uint64), np.array(self.shifts, np.uint64)
        for length, budget in enumerate(self.budgets):
            at = (ring + length) % self.m
            masks = (np.uint64(1) << widths[at]) - np.uint64(1) if self.m > 1 else np.uint64(0xFFFFFFFFFFFFFFFF)
            total += np.bitwise_count((differences >> shifts[at]) & masks)
            ok &= total <= budget
        return ok


def _spanning(fps: np.ndarray, ring: int, segments: Ring) -> tuple[list, list]:
    """Links that span the clusters of one block: each fingerprint meets only those not reached yet."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = segments.linked(rest ^ at, ring)
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                left.append(np.full(len(found), at))
                right.append(found)
    return left, right


def _block_links(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, ring: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        segments = Ring(threshold)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(keys)])
        left, right = [], []
        small = np.repeat(sizes <= 8, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, 8):  # small blocks: every pair at this distance, all blocks at once
            at = np.flatnonzero(small[step:] & (group[step:] == group[:-step]))
            if not len(at):
                break
            near = at[segments.linked(fps[at] ^ fps[at + step], ring[at])]
            left.append(fps[near])
            right.append(fps[near + step])
        for k in np.flatnonzero(sizes > 8):
            a, b = _spanning(fps[starts[k]: starts[k] + sizes[k]], int(ring[starts[k]]), segments)
            left += a
            right += b
        if not left:
            return pa.RecordBatch.from_pylist([], schema=schema)
        pair = np.unique(np.sort(np.stack([np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(last: bool):
            rows = np.concatenate(held)
            keys = rows[:, :4]
            cut = len(rows) if last else int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            held[:] = [rows[cut:]]
            return links(keys[:cut], rows[:cut, 0], np.ascontiguousarray(rows[:cut, 4]).view(np.uint64)) if cut else None

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                out = flush(False)
                size = len(held[0])
                if out is not None:
                    yield out
        if held:
            yield flush(True)

    return run


def links(fps: DataFrame, threshold: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` (column fp) whose components are
    those of all links at ``threshold`` or fewer bits."""
    # A fingerprint becomes some 35 entries.  They are made in as many tasks as a shuffle has: adaptive execution
    # would merge the few bytes of the fingerprints, and drop a repartition by the hash they already lie by.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = fps.repartition(tasks, F.xxhash64("fp")).select("fp", Ring(threshold).entries("fp"))
    sizes = entries.groupBy("ring", "bucket").agg(F.count("*").alias("n"), F.max("exact").alias("any")).where("n > 1 AND any")
    sizes = write_through(sizes, "buckets")  # a join of two plain exchanges, which can split a large bucket
    shared = entries.join(sizes.select("ring", "bucket", "n"), ["ring", "bucket"]).withColumn("parts", F.ceil(F.col("n") / BLOCK_ENTRIES))
    # a bucket in parts: every two parts meet in one block
    blocks = shared.withColumn("own", F.expr("pmod(xxhash64(fp, ring, bucket), parts)")).select(
        "ring", "bucket", F.explode(F.expr("transform(sequence(0L, parts - 1), p -> struct(least(own, p) AS u, greatest(own, p) AS v))")).alias("p"),
        "fp").select("ring", "bucket", "p.u", "p.v", "fp")
    dealt = blocks.repartition("ring", "bucket", "u", "v").sortWithinPartitions("ring", "bucket", "u", "v")
    return dealt.mapInArrow(_block_links(threshold), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge.

    Large-star and small-star steps in turn until nothing changes; each step is written to the
    shared folder, so a lost executor costs one step at most."""
    def state(e):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).head())

    now = write_through(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name)
    seen = state(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.selectExpr("inline(array(struct(a AS a, m AS b), struct(b AS a, m AS b)))").where("a <> b").distinct()
        now = write_through(small, name)
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.selectExpr("a AS node", "b AS root")


def classes(rows: DataFrame, threshold: int = MAX_BITS) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``rows``: equal roots are one near-duplicate class."""
    fps = rows.select("fp").distinct()
    roots = components(links(fps, threshold))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS,
                    threshold: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest id reachable) for every row.

    A null or empty text has fingerprint zero and links like any other.  Null ids belong to
    components but name none, unless a component has no other (then its id is null).  Repeated rows
    are one class.  Extra columns are not read.  An empty table gives no rows.
    """
    rows = write_through(docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(F.col(text_column), words).alias("fp")), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = classes(rows, threshold)
    ids = own.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS,
                         threshold: int = MAX_BITS) -> DataFrame:
    """The input's columns of one row per near-duplicate class: that with the smallest id, of
    repeated rows the first written; a class with null ids only keeps one of them."""
    rows = write_through(carry(docs, doc_id=F.col(id_column), fp=fingerprint_column(F.col(text_column), words),
                               tag=F.monotonically_increasing_id()), "fingerprinted")
    small = rows.select("doc_id", "fp", "tag")
    rooted = small.join(classes(small, threshold), "fp")
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("first"))
    kept = rooted.join(first, "root").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("root").agg(F.min("tag").alias("tag"))
    return carried(rows.join(kept.select("tag"), "tag", "left_semi").select(ROW), docs.columns)
