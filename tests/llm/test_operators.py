"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties and
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import hosts, mixing, packing, passages, quality, repeats, runs, secrets, simhash, tokens, topk, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, k long, fp string, tag long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = prose(70), prose(6000)
    near = prose(400)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [None, "", " \t\n", "one", "a b c", passage, prose(20) + " " + passage + "\n" + prose(30), passage + "\t" + prose(5),
             long, long, long + " more", near, near, near.replace(vocabulary[0], vocabulary[1], 1), "x " * 4000, "ab" * 900,
             f"{prose(30)} token = \"{secret}\" {prose(30)}", f"key AKIA{'ABCD1234' * 2} {prose(20)} PASSWORD: abc secret=token:{secret}",
             "# " * 300 + prose(40), "line one is here\n" * 9, prose(12) + " 中文 text <|endoftext|> \x00\x1c　 ½ œ"]
    return texts + [prose(rng.randint(10, 120)) for _ in range(40)]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en", f"src{k % 3}", len(t) if t else None, "w", k, "f", 0) for k, t in enumerate(_texts())]
    return out + [out[6], out[6], (None, _texts()[6], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_counts_and_verdicts(docs, rows, empty):
    want = Counter()
    for row in rows:
        text = row[1] or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i:i + 5])].append(i)
        covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[(row[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)] += 1
    report = quality.quality_report(docs)
    assert _counted(report, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not report.where("base_failed AND kept").count()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == report.where("kept").count()
    assert quality.quality_report(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def _em(counts, share, bad, weight, rounds):
    """Share of each kind, probability of bad votes, posterior of good per pattern; in matrices."""
    patterns = np.array(sorted(counts))
    n = np.array([counts[tuple(p)] for p in patterns.tolist()], float)
    share0, bad0, prior = share, bad, weight * n.sum() * share
    negative, given = (patterns == -1).astype(float), (patterns != 0).astype(float)
    for _ in range(rounds):
        log = np.log(share) + negative @ np.log(bad).T + (given - negative) @ np.log(1 - bad).T
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w *= (n / w.sum(axis=1))[:, None]
        share = (prior + w.sum(axis=0)) / (1 + weight) / n.sum()
        bad = (prior[:, None] * bad0 + w.T @ negative) / (prior[:, None] + w.T @ given)
    log = np.log(share) + negative @ np.log(bad).T + (given - negative) @ np.log(1 - bad).T
    like = np.exp(log)
    return share, bad, dict(zip(map(tuple, patterns.tolist()), like[:, 0] / like.sum(axis=1)))


def test_quality_posteriors_equal_a_plain_em_and_agree_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    frame = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).selectExpr("_row.doc_id", "votes", "base_failed", "kept", "p_good").cache()
    judged = frame.toPandas()
    n = len(quality.RULES)
    share, bad = np.array([0.88] + [0.02] * n), np.full((n + 1, n), 0.1)
    bad[0], bad[np.arange(1, n + 1), np.arange(n)] = 0.005, 0.8
    share, bad, want = _em(Counter(tuple(v) for v in judged.votes), share, bad, 0.1, 40)
    assert all(abs(want[tuple(v)] - p) < 1e-9 for v, p in zip(judged.votes, judged.p_good))
    state = quality.pattern_posteriors(frame.select("votes")).head().state
    assert np.allclose(state.share, share) and np.allclose(state.bad, bad)
    # the estimates moved off their start, and none stands at 0 or 1
    assert bad.min() > 0 and bad.max() < 1 and (abs(bad[0] - 0.005) > 1e-4).all() and abs(share[1:] - 0.02).min() > 1e-3
    # junk that two rules see is one kind to both: lines and repeats
    kind = bad[1:, 4].argmax() + 1
    assert bad[kind, 3] > 0.5 and bad[kind, 4] > 0.9
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna().merge(judged[~judged.base_failed], on="doc_id")
    assert labels[labels.quality == 1].kept.mean() > 0.99 and labels[labels.quality == 0].kept.mean() < 0.1
    assert judged.p_good.notna().all() and judged[judged.votes.map(min) >= 0].p_good.min() > 0.9


def test_estimates_are_the_same_at_every_size(spark):
    counts = {(1, 1): 880, (1, -1): 60, (-1, -1): 40, (0, 0): 15, (-1, 1): 5}
    votes = [v for v, n in counts.items() for _ in range(n)]
    one = spark.createDataFrame([(list(v),) for v in votes], "votes array<int>")
    small, large = ({tuple(r.votes): r.p_good for r in quality.pattern_posteriors(d, 2).collect()} for d in (one, one.crossJoin(spark.range(30)).select("votes")))
    assert small.keys() == counts.keys() and all(abs(small[v] - large[v]) < 1e-9 for v in counts)
    assert quality.pattern_posteriors(one.limit(0), 2).count() == 0


def test_base_secrets_by_plain_patterns(docs, rows, empty):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    want = Counter()
    for row in rows:
        text, found = row[1] or "", []
        found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        want[(row[0], *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(written.encode()).hexdigest())] += 1
    assert _counted(secrets.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not clean.where("text rlike '[0-9a-f]{40}'").count() and secrets.scan(empty).count() == secrets.redact(empty).count() == 0


def test_inferred_formats_find_unlabelled_credentials():
    rng = random.Random(1)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    classes = lambda x: x.translate(secrets.CLASS_OF)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(16, 26))) for _ in range(600)] + ["INTERNATIONALSIERUNG", "4539578763621486"] * 20
    formats = secrets.Formats([secrets.infer([classes(token()) for _ in range(300)])], secrets.infer([classes(w) for w in words]))
    assert all(formats.score(token()) > secrets.THRESHOLD for _ in range(50))
    assert not any(formats.score(w) > secrets.THRESHOLD for w in words)


def test_token_ids_equal_the_library():
    rng = random.Random(2)
    own = tokens.Encoder()
    pieces = [" ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "'s", "'ll", "12", "½", "ª", "\x85", "\xa0", " ", "　", "œ", "中", "😀", "\x00", "\x1c", "!", "<|endoftext|>", "ſ", "'"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [t for t in _texts() if t]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 513, 4000):
        ids = rng.zipf(1.3, n).clip(0, 50_000).astype("<u4")
        matrix = wavelet.WaveletMatrix.build(ids)
        assert (matrix.decode() == ids).all()
        if n:
            at = rng.integers(0, n, 64)
            assert (matrix.access(at) == ids[at]).all()
        for token in {*ids[:30].tolist(), 7, 49_999}:
            where = np.flatnonzero(ids == token)
            assert (matrix.occurrences(token) == where).all() and matrix.rank(token, n) == len(where)
            assert matrix.rank(token, n // 2, n // 4) == (ids[n // 4: n // 2] == token).sum()
            assert matrix.select(token, 0) == (where[0] if len(where) else -1) and matrix.select(token, len(where)) == -1


def test_token_files_round_trip(spark, docs, rows, empty):
    own = tokens.Encoder()
    got = wavelet.read_docs(spark, wavelet.write_tokens(docs, shard_tokens=5000)).collect()
    want = Counter((r[0], len(x) // 4 + 1, zlib.crc32(x + b"\x02\0\0\0")) for r, x in zip(rows, own.encode([r[1] for r in rows])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    assert wavelet.read_docs(spark, wavelet.write_tokens(empty)).count() == 0


def test_token_files_answer_counts_places_and_access(spark, docs, rows, empty):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are written by one task
    try:
        path = wavelet.write_tokens(docs, shard_tokens=3000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(wavelet.read_docs(spark, path).collect(), key=lambda r: r.start)
    shards = spark.read.schema(wavelet.SHARD).parquet(path).select("shard", "n_tokens").orderBy("shard").collect()
    assert len({r.shard >> 24 for r in shards}) > 1 and len(shards) > len({r.shard >> 24 for r in shards})  # several tasks, several shards of one
    offsets = {r.shard: r.before for r in wavelet.shard_offsets(spark, path).collect()}
    assert [offsets[r.shard] for r in shards] == [sum(x.n_tokens for x in shards[:k]) for k in range(len(shards))]
    own, by_crc = tokens.Encoder(), {}
    for r, x in zip(rows, own.encode([r[1] for r in rows])):
        by_crc[r[0], zlib.crc32(x + b"\x02\0\0\0")] = np.append(np.frombuffer(x, "<u4"), 2)
    ids = np.concatenate([by_crc[r.doc_id, r.ids_crc32] for r in order])
    asked = [2, int(ids[0]), int(ids[len(ids) // 2]), 50_000]
    counts = Counter()
    for r in wavelet.token_counts(spark, path, asked).collect():
        counts[r.token] += r.n
    assert counts == Counter({t: int((ids == t).sum()) for t in asked})
    found = sorted(map(tuple, wavelet.token_places(spark, path, asked).collect()))
    assert found == sorted((t, int(p)) for t in set(asked) for p in np.flatnonzero(ids == t))
    places = [0, 1, 2999, 3000, 3001, len(ids) - 1, len(ids) // 3, len(ids), -1, 0]
    got = sorted(map(tuple, wavelet.tokens_at(spark, path, places).collect()))
    assert got == sorted((p, int(ids[p])) for p in places if 0 <= p < len(ids))
    nothing = wavelet.write_tokens(empty)
    assert not wavelet.token_counts(spark, nothing, [2]).count() and not wavelet.token_places(spark, nothing, [2]).count() and not wavelet.tokens_at(spark, nothing, [0]).count()


def test_packing_is_whole_gapless_and_near_the_bound(docs, rows, empty):
    got = packing.pack(docs, capacity=256).toPandas()
    own, want = tokens.Encoder(), Counter()
    for row, ids in zip(rows, own.encode([r[1] for r in rows])):
        ids += b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range(n % 256 or 256, n, 256), n]
        want.update((row[0], k, a, b - a, zlib.crc32(ids[4 * a: 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.02 * packing.lower_bound(got.length.to_numpy(), 256) + 1
    assert (got.slot_sequences >= got.slot_bound).all() and (got.certified == (got.slot_sequences == got.slot_bound)).all()
    full = got[got.length == 256]
    assert len(full) and full.certified.all() and (got[got.length < 256].slot_bound > 1).all()
    assert packing.pack(empty).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 65, rng.integers(1, 60)))[::-1]
        bins, offsets = packing.best_fit_decreasing(lengths, 64)
        assert packing.lower_bound(lengths, 64) <= bins.max() + 1 and (offsets + lengths <= 64).all()
    assert packing.lower_bound(np.array([33, 33, 33]), 64) == 3


def _brute_repeats(rows, least):
    count = Counter(t[i:i + least] for r in rows for t in [(r[1] or "").encode()] for i in range(len(t) - least + 1))
    out = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if count[t[i:i + least]] > 1:
                gone[i:i + least] = [True] * least
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(r[0], len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_repeats_equal_brute_force(docs, rows, empty, hot):
    got = repeats.remove_repeats(docs, hot=hot)
    assert _counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _brute_repeats(rows, 200)
    assert repeats.remove_repeats(empty).count() == 0


def test_interval_expansion_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        least = rng.choice([9, 12, 20, 40])
        base = bytes(rng.choice(rng.choice([b"ab", b"abcdefgh "])) for _ in range(rng.randint(least, 200)))
        texts = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randrange(len(base))
            texts.append(base[a: a + rng.randint(1, 150)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))))
        windows = [max(0, len(t) - least + 1) for t in texts]
        count = Counter(t[i:i + least] for t, w in zip(texts, windows) for i in range(w))
        got = repeats.repeated_starts(texts, windows, least)
        assert [g.tolist() for g in got] == [[count[t[i:i + least]] > 1 for i in range(w)] for t, w in zip(texts, windows)]


def test_passages_equal_brute_force(docs, rows, empty):
    low = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            if r[0] is not None:
                key = tuple(w[i:i + 50])
                low[key] = min(low.get(key, r[0]), r[0])
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {j for i in range(len(w) - 49) if r[0] is not None and low[tuple(w[i:i + 50])] < r[0] for j in range(i, i + 50)}
        want[(r[0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())] += 1
    assert _counted(passages.remove_passages(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert passages.remove_passages(empty).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in rng.normal(size=8).astype("f4")], "x") for k in range(120)]
    vectors += [(200 + k, vectors[3][1], "x") for k in range(30)]  # ties
    vectors += [(300, None, "x"), (350, [1.0, None] * 4, "x"), (400, [float("nan")] * 8, "x"), (450, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (500, [], "x")]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, id string")
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in usable if j != i)[:5]
            want |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)}
    assert {tuple(r) for r in topk.nearest(table).collect()} == want
    assert topk.nearest(table.limit(0)).count() == 0


def test_copies_of_one_row_spread_over_blocks_and_one_vector_asks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rows = [(7, [1.0, 0.5])] * 1500 + [(50, [0.25, 1.0]), (50, [0.125, 2.0]), (8, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(map(tuple, topk.nearest(table, k=3).collect()))
    assert got == [(50, 1, 8, 512 * 256), *((50, k, 7, 32 * 256 + 512 * 128) for k in (2, 3))]
    salted = topk.quantised(table).selectExpr("pmod(xxhash64(id, monotonically_increasing_id()), 24) AS b").groupBy("b").count().collect()
    assert max(r["count"] for r in salted) < 150


def _brute_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(docs, rows, empty):
    fps = [_brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{f:016x}", min(low[find(i)], default=None)) for i, (r, f) in enumerate(zip(rows, fps)))
    assert _counted(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == simhash.keep_representatives(empty).count() == 0


@pytest.mark.parametrize("threshold", [1, 3, 4])
def test_pigeonring_links_lose_no_component(spark, threshold):
    rng = random.Random(threshold)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in seeds for _ in range(60)}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    roots = {r.fp: r.root for r in simhash.classes(spark.createDataFrame([(x,) for x in signed], "fp long"), threshold).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & mask).bit_count() <= threshold:
                parent[find(x)] = find(y)
    groups = defaultdict(set)
    for x in signed:
        groups[find(x)].add(x)
    assert all(len({roots[x] for x in g}) == 1 and min(g) == roots[next(iter(g))] for g in groups.values())
    assert len(set(roots.values())) == len(groups)


def test_mixing_counts_are_poisson_draws(docs, rows, empty, monkeypatch):
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    want = Counter()
    for r in rows:
        doc = "" if r[0] is None else str(r[0])
        u = int(hashlib.md5(f"{doc}:0".encode()).hexdigest()[:13], 16) / 16**13
        rate, k, term = rates[r[3]], 0, np.exp(-rates[r[3]])
        total = term
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        want.update((r[0], c) for c in range(k))
    assert _counted(mixing.mix_report(docs), "doc_id", "copy") == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert _counted(mixing.mix_report(docs), "doc_id", "copy") == want
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty).count() == 0
    assert {r.source for r in mixing.mix(docs, {"src1": 1.0}).collect()} <= {"src1"}


def test_large_rates_are_drawn_in_parts(spark):
    docs = spark.createDataFrame([(k, f"{k} tiny", "t") for k in range(3)] + [(10 + k, "x" * 6, "big") for k in range(300)], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("t", 5000.0), ("big", 250.0)], "source string, rate double")
    got = Counter(r.doc_id for r in mixing.replicate(docs, rates).selectExpr("_row.doc_id").collect())
    for doc, parts, rate in [(k, 50, 100.0) for k in range(3)] + [(10 + k, 3, 250 / 3) for k in range(300)]:
        want = 0
        for j in range(parts):
            u = int(hashlib.md5((f"{doc}:0" if j == 0 else f"{doc}:0:{j}").encode()).hexdigest()[:13], 16) / 16**13
            k, term = 0, np.exp(-rate)
            total = term
            while total <= u:
                k += 1
                term *= rate / k
                total += term
            want += k
        assert got[doc] == want
    assert abs(sum(got[k] for k in range(3)) / 15000 - 1) < 0.03
    # a million copies of one row
    one = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert abs(mixing.replicate(one, spark.createDataFrame([("s", 1e6)], "source string, rate double")).count() / 1e6 - 1) < 0.005


def test_mixing_reaches_target_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "'0123456789' AS text")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert got["a"] == pytest.approx(15_000, rel=0.03) and got["b"] == pytest.approx(5_000, rel=0.05)


def test_hosts_rules_and_reputations(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/a?x", "http://a.example.net/de/", "x://example.net", "https://b.ORG/fr/x#t", "http://org/fr",
            "http://www.example.com/de/1", "http://example.com/den", "http://notexample.com/de/", "http://u.example.org?q=://z/", "http://ÄB.com/"]
    rows = [(k, u, "h", "clash") for k, u in enumerate(urls)] + [(100 + k, f"http://bad.site.example.org/{k}", "h", "c") for k in range(40)]
    rows += [(200 + k, f"http://good.place.example.org/{k}", "h", "c") for k in range(40)] + [(None, "http://bad.site.example.org/n", None, None)]
    labels = spark.createDataFrame([(100 + k, 0, 0) for k in range(30)] + [(200 + k, 1, 0) for k in range(30)] + [(100, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in hosts.judge_pages(pages, labels).collect()}
    parsed = {k: (got[k].host, got[k].path, got[k].rule) for k in range(len(urls))}
    assert parsed == {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("example.net", "/en/a", "example.net/en/"), 4: ("a.example.net", "/de/", "net/"),
                      5: ("example.net", "", None), 6: ("b.org", "/fr/x", "org/fr/"), 7: ("org", "/fr", None), 8: ("www.example.com", "/de/1", "example.com/de/"),
                      9: ("example.com", "/den", None), 10: ("notexample.com", "/de/", None), 11: ("u.example.org", "", None), 12: ("Äb.com", "/", None)}
    assert all(got[k].verdict == "block" for k in [*range(100, 140), None]) and all(got[k].verdict == "allow" for k in range(200, 240))
    assert got[11].verdict == "allow" and len(got) == len(rows)
    assert hosts.judge_pages(pages.limit(0), labels).count() == 0 and hosts.judge_pages(pages, labels.limit(0)).count() == len(rows)


def test_hosts_outcomes_by_document_and_lift(spark):
    rows = [(k, f"http://bad.example.org/en/{1000 + k}{'/' if k % 2 else '.html'}?p=7") for k in range(40)]
    rows += [(100 + k, f"http://good.example.org/de/{2000 + k}#1") for k in range(400)] + [(900, "http://bad.example.org/en/x12")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1000 + k, int(k % 3 > 0), 0) for k in range(40)] + [(2000 + k, 1, 0) for k in range(400)] + [(100, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    document = hosts.document_of(pages.url)
    numbers = {r.page_id: r.d for r in pages.select("page_id", document.alias("d")).collect()}
    assert numbers == {**{k: 1000 + k for k in range(40)}, **{100 + k: 2000 + k for k in range(400)}, 900: None}
    got = {r.page_id: r.verdict for r in hosts.judge_pages(pages, labels, document=document, lift=1.0).collect()}
    assert {got[k] for k in [*range(40), 900]} == {"block"} and {got[k] for k in range(100, 500)} == {"allow"}


def test_repeats_of_a_frequent_passage_do_not_meet_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, expand = words(500), repeats._expand
    rows = [(k, words(150) + passage + words(150)) for k in range(40)] + [(50, words(400)), (51, passage[:250])]

    def checked(least):
        solve = expand(least)

        def run(batches):
            batches = list(batches)
            sizes = Counter(tuple(r.get(c) for c in ("h", "part")) for b in batches for r in b.to_pylist())
            assert max(sizes.values(), default=0) <= 10
            yield from solve(iter(batches))

        return run

    monkeypatch.setattr(repeats, "_expand", checked)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=10)
    assert _counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _brute_repeats(rows, 200)


def test_repeated_rows_meet_their_text_once(spark):
    text = " ".join(f"w{k * 7919 % 1009}" for k in range(120))
    rows = [(7, text)] * 30 + [(None, text)] * 30 + [(8, text + " x"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = runs.named(docs)
    table = runs.run_table(named, passages._measure(50, 16), "test-runs")
    met = runs.with_text(runs.once(named, table), runs.per_row(runs.occurrences(table), "loc")).collect()
    counts = {(r.doc_id, r.k): r.n for r in table.selectExpr("doc_id", "k", "size(runs) AS n").collect()}
    assert sorted(len(r.found) for r in met) == sorted(n for n in counts.values() if n) and len(met) == 3
    assert runs.once(named, table).count() == 4
    got = repeats.remove_repeats(docs)
    assert _counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _brute_repeats(rows, 200)
    gone = {(r.doc_id, r.n_removed) for r in passages.remove_passages(docs).collect()}
    assert gone == {(7, 0), (None, 0), (8, 120), (9, 0)}


def test_credentials_behind_names_and_beside_finds(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    classes = lambda x: x.translate(secrets.CLASS_OF)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(16, 26))) for _ in range(600)]
    formats = secrets.Formats([secrets.infer([classes(hexes(22).upper()) for _ in range(300)])], secrets.infer([classes(w) for w in words]))
    value, other = hexes(22).upper(), hexes(40)
    for text in (f"DB_KEY={value}", f"x/path/{value}", f"a.b={value}", f"a=b/{value}/c", f"{other}/{value}", f"AZ={value}/{other}"):
        base, spans = secrets.scan_text(f"see {text} now", formats)
        assert [f"see {text} now"[s:e] for s, k, e, _ in spans if k == 3] in ([value], [value + "/"], [value + "/c"]), text
        assert value not in secrets.redact_text(f"see {text} now", spans)
    docs = spark.createDataFrame([(k, f"password: {hexes(10)} {words[k]} plainword") for k in range(50)], "doc_id long, text string")
    assert secrets.learn(docs).least == 10 and secrets.learn(docs.limit(0)) is None
