"""Balanced packing, periodic runs and centroid clustering against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from orrery.llm import clusters, differencing, periodic, tokens
from test_operators import WORD, docs, empty, rows  # noqa: F401  (fixtures)


def _differencing(lengths, windows):
    """The textbook form: all windows written out; of equal imbalances the older goes first."""
    parts = [[x] + [0] * (windows - 1) for x in sorted(lengths, reverse=True)]
    parts = [(max(p) - min(p), -number, p) for number, p in enumerate(parts)]
    for number in range(len(parts), 2 * len(parts) - 1):
        parts.sort()
        a, b = parts.pop()[2], parts.pop()[2]
        c = [x + y for x, y in zip(sorted(a, reverse=True), sorted(b))]
        parts.append((max(c) - min(c), -number, [x - min(c) for x in c]))
    return max(parts[0][2]) - min(parts[0][2])


def test_differencing_against_the_textbook_form():
    rng = random.Random(3)
    for _ in range(300):
        n, windows = rng.randint(1, 25), rng.randint(1, 9)
        lengths = rng.sample(range(1, 2000), n)
        bins = differencing.differencing(np.array(lengths), windows)
        sums = np.bincount(bins, weights=lengths, minlength=windows)
        assert len(sums) == windows and sums.max() - sums.min() == _differencing(lengths, windows), (lengths, windows)
    assert len(differencing.differencing(np.zeros(0, np.int64), 3)) == 0


def test_windows_rise_until_all_fit_and_stay_near_equal():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 513, 3000), np.full(100, 1500), np.array([2047, 2, 2047, 2]), np.concatenate((np.full(900, 512), rng.integers(1, 512, 500)))):
        sums = np.bincount(differencing.balanced(lengths, 2048), weights=lengths)
        assert sums.max() <= 2048 and sums.sum() == lengths.sum() and sums.min() > 0
    lengths = np.concatenate((np.full(2000, 512), rng.integers(1, 512, 2000)))
    sums = np.bincount(differencing.balanced(lengths, 2048), weights=lengths)
    assert 1 - lengths.sum() / 2048 / len(sums) < 0.02


def test_balanced_packing_holds_every_id_once(spark, docs, rows, empty):  # noqa: F811
    own = tokens.Encoder()
    for capacity, cut, slot in ((2048, 512, 8192), (64, 16, 30)):
        packed = differencing.pack(docs, capacity=capacity, piece_tokens=cut, slot_pieces=slot).collect()
        by_window, by_doc = defaultdict(list), defaultdict(list)
        for r in packed:
            by_window[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append(r)
        for parts in by_window.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
        want = Counter()
        for doc_id, text, *_ in rows:
            ids = np.append(own.whole.encode(text or "", add_special_tokens=False).ids, differencing.END_ID).astype("<u4")
            whole = len(ids) - len(ids) % capacity
            starts = [*range(0, whole, capacity), *range(whole, len(ids), cut)]
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                want[(doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids))] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == want
    assert differencing.pack(empty).count() == 0 and differencing.padding(differencing.pack(empty)).head() == (0, 0, 0)
    with pytest.raises(ValueError):
        differencing.pack(docs, piece_tokens=4096)


def test_padding_counts_powers_of_two_as_full(spark):
    packed = spark.createDataFrame([(1, 1024), (2, 1000), (2, 24), (3, 2048), (4, 2000), (5, 1)], "sequence_id long, length long")
    assert differencing.padding(packed).head() == (5, 6097, 48)


def _runs(words, min_length=6, min_exponent=4):
    out, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(min_length, min_exponent * q) and not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_against_brute_force():
    rng, found = random.Random(1), 0
    for _ in range(1500):
        words = []
        while len(words) < rng.randint(0, 60):
            words += [rng.choice("ab") for _ in range(rng.randint(1, 5))] * rng.randint(1, 8) if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(1, 6))]
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            want = _runs(words, least, exponent)
            found += len(want)
            assert periodic.find_runs(words, least, exponent) == want, (words, least, exponent)
    assert found > 5000
    assert periodic.find_runs(["x"] * 20000) == [(0, 20000, 1)]
    assert periodic.find_runs([str(k % 977) for k in range(20000)]) == [(0, 20000, 977)]
    with pytest.raises(ValueError):
        periodic.find_runs(["a"], 6, 1)


def test_run_report_of_whole_rows(docs, rows, empty):  # noqa: F811
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, planted = Counter(), 0
    for doc_id, text, *_ in rows:
        original = WORD.findall(text or "")
        words, n = list(original), len(original)
        if doc_id is not None and n and not (h := zlib.crc32(str(doc_id).encode())) % 10:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = _runs(words) if n < 700 else periodic.find_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(doc_id, len(runs), *row, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))] += 1
    found = periodic.run_report(periodic.periodic_runs(docs, rewrite=periodic.repeat_tail))
    assert Counter(map(tuple, found.collect())) == want and planted
    assert periodic.run_report(periodic.periodic_runs(empty)).count() == 0


def test_transform_is_exact_and_pruning_keeps_the_nearest():
    walsh = clusters.walsh_matrix(64)
    assert (walsh @ walsh.T == 64 * np.eye(64)).all() and (np.diff((np.diff(walsh, axis=1) != 0).sum(axis=1)) == 1).all()
    rng = np.random.default_rng(7)
    for size, scale in ((64, 300), (64, 2**18), (16, 3), (2, 2), (1, 5)):
        x, c = rng.integers(-scale, scale + 1, (500, size)), rng.integers(-scale, scale + 1, (9, size))
        c[4], x[:9] = c[2], c  # ties and zero distances
        distances = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        cluster, distance = clusters.assign(clusters.transformed(x), clusters.transformed(c))
        assert (cluster == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()
        assert (clusters.components(clusters.transformed(c)) == c).all()
    with pytest.raises(ValueError):
        clusters.walsh_matrix(12)


def _k_means(vectors, k, rounds):
    x = np.array([v for _, v in vectors], np.int64)
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest(), clusters.transformed(x[i:i + 1])[0].tolist()))
    c = x[order[:k]].copy()
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(axis=0) // (near == j).sum()
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    near, d = d.argmin(axis=1), d.min(axis=1)
    return Counter((vectors[i][0], int(near[i]), int(d[i]), int(d[near == near[i]].sum()), int(d.sum()),
                    hashlib.sha256(",".join(map(str, c[near[i]])).encode()).hexdigest()) for i in range(len(x)))


def test_clusters_of_odd_tables(spark):
    rng = np.random.default_rng(8)
    schema = "vec_id long, embedding array<float>, label int, cluster string, v string, distance double"
    make = lambda ids, size=64: [(k, [float(x) for x in rng.normal(0, 0.2, size).astype(np.float32)], 1, "c", "v", 0.5) for k in ids]
    good = make(range(150)) + make([None, None])
    good += good[:3] + [(7, good[11][1], 1, "c", "v", 0.5)]  # repeated rows, another vector of a known id
    bad = make(range(900, 905), 63) + [(k, v, 0, None, None, None) for k, v in enumerate((None, [], [None] * 64, [float("nan")] + [0.0] * 63, [0.0] * 63 + [float("inf")]))]
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for table, k, rounds in ((good + bad, 8, 10), (good[:3], 8, 10), (good, 8, 0), (good[:1] * 5, 2, 3)):
        want = _k_means([(r[0], np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64)) for r in table if r in good], k, rounds)
        got = clusters.cluster(spark.createDataFrame(table, schema).repartition(3), clusters=k, rounds=rounds).select(*columns)
        assert Counter(map(tuple, got.collect())) == want
    assert clusters.cluster(spark.createDataFrame(bad, schema)).count() == 0
    with pytest.raises(Exception, match="not supported"):
        clusters.cluster(spark.createDataFrame([(1, [1e6] * 64, 1, "c", "v", 0.5)], schema)).count()
