"""Wide windows of the exact substring operators, credentials among documents, page outcomes of the registered query."""

import hashlib
import random
import string
from collections import Counter

import pytest

from orrery.llm import hosts, passages, repeats, secrets
from orrery.llm.queries import QUERIES
from test_operators import WORD, _brute_repeats, _counted

SF = "/root/testdata/sf0.01"


def _wide(spark, unit, joiner, n):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(unit))
    shared = joiner.join(word() for _ in range(n))
    rows = [(k, joiner.join(word() for _ in range(60 + 7 * k)) + joiner + shared[k:] + joiner + word()) for k in range(4)]
    return rows + [(9, shared[: len(shared) // 3])], spark.createDataFrame(rows + [(9, shared[: len(shared) // 3])], "doc_id long, text string")


@pytest.mark.parametrize("least", [64, 319, 320, 400, 600, 2000])
def test_repeats_of_any_length_equal_brute_force(spark, least):
    rows, docs = _wide(spark, 5, " ", 420)
    got = repeats.remove_repeats(docs, least=least)
    assert _counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _brute_repeats(rows, least)


@pytest.mark.parametrize("window", [16, 271, 272, 400, 800])
def test_passages_of_any_length_equal_brute_force(spark, window):
    rows, docs = _wide(spark, 4, " ", 900)
    low, want = {}, Counter()
    words = {k: WORD.findall(t) for k, t in rows}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            low.setdefault(tuple(w[i:i + window]), k)
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if low[tuple(w[i:i + window])] < k for j in range(i, i + window)}
        want[(k, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())] += 1
    assert _counted(passages.remove_passages(docs, window=window), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_windows_out_of_range_are_refused_before_any_job(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for wrong in (60, 63, 64 + 4096):
        with pytest.raises(ValueError, match="least"):
            repeats.remove_repeats(docs, least=wrong)
    for wrong in (10, 15, 16 + 4096):
        with pytest.raises(ValueError, match="window"):
            passages.remove_passages(docs, window=wrong)


LETTERS = string.ascii_letters + string.digits
FORMATS = {
    "uuid": lambda r: "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
    "mixed": lambda r: "tk_" + "".join(r.choice(LETTERS) for _ in range(36)),
    "base64": lambda r: "".join(r.choice(LETTERS + "+/") for _ in range(r.randint(40, 44))) + "=",
    "hex20": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(20)),
}


def test_planted_credentials_are_found_and_words_are_not(spark):
    """200 labelled values of each format; 50 unlabelled ones, without a name, in other documents."""
    rng = random.Random(3)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids, planted = sorted(docs), {}
    for make in FORMATS.values():
        for _ in range(200):
            docs[rng.choice(ids)] += f'\napi_key = "{make(rng)}"\n'
    for name, make in FORMATS.items():
        for _ in range(50):
            value, k = make(rng), rng.choice(ids)
            docs[k] += f" see {value} here"
            planted[k, value] = name
    found, other = Counter(), Counter()
    for r in secrets.scan(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(4)).where("n_format > 0").collect():
        for kind, start, end in (s.split(":") for s in r.spans.split(",")):
            value = docs[r.doc_id][int(start):int(end)]
            if kind == "format" and (r.doc_id, value) in planted:
                found[planted[r.doc_id, value]] += 1
            elif kind == "format" and not any(d == r.doc_id and value in v for d, v in planted):
                other[value] += 1
    assert not other and all(found[name] >= 45 for name in FORMATS), (found, other)


def test_no_ordinary_text_of_the_documents_is_a_credential(spark):
    report = secrets.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert report.agg({"n_hex": "sum"}).head()[0] > 100 and not report.where("n_format > 0").count()


def test_format_states_keep_depth_and_unseen_pairs_never_pass():
    rng = random.Random(5)
    classes = lambda x: x.translate(secrets.CLASS_OF)
    samples = sorted(classes("".join(rng.choice("0123456789abcdef") for _ in range(40))) for _ in range(130))
    automaton = secrets.infer(samples)
    assert len(automaton.goto) > 40 and max(automaton.depth) == 40
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(16, 26))) for _ in range(600)] + ["4539578763621486"] * 20
    formats = secrets.Formats([automaton], secrets.infer_ordinary(sorted(classes(w) for w in words), [], [automaton]))
    score = lambda n: formats.score("".join(rng.choice("0123456789abcdef") for _ in range(n)))
    assert min(score(40) for _ in range(50)) > secrets.THRESHOLD and score(41) == score(200) == secrets.IMPOSSIBLE
    assert formats.score("ONANLYSHBLEONND.") == secrets.IMPOSSIBLE and formats.score("4539578763621486") < 0
    # unlabelled ones among the ordinary samples are set aside
    mixed = secrets.infer_ordinary(sorted([classes(w) for w in words] + samples[:60]), [], [automaton])
    again = secrets.Formats([automaton], mixed)
    assert again.score("0123456789abcdef" * 2 + "deadbeef") > secrets.THRESHOLD


def test_registered_url_filter_blocks_hosts_over_the_overall_rate(spark):
    judged = QUERIES["op10_url_filters"](spark, "/root/testdata/sf0.1").cache()
    open_ = judged.where("rule IS NULL")
    blocked = open_.where("verdict = 'block'")
    assert blocked.count() > 100 and open_.count() > 4 * blocked.count()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality IS NOT NULL OR toxic IS NOT NULL")
    outcome = pages.select("page_id", hosts.document_of(pages.url).alias("doc_id")).join(labels, "doc_id").selectExpr(
        "page_id", "CAST(quality = 0 OR toxic = 1 AS DOUBLE) AS bad").groupBy("page_id").max("bad").toDF("page_id", "bad")
    rate = {r.verdict: r.bad for r in open_.join(outcome, "page_id").groupBy("verdict").agg({"bad": "avg"}).toDF("verdict", "bad").collect()}
    assert rate["block"] > 1.3 * rate["allow"]


def test_secrets_longer_than_the_first_sample_length_are_found(spark):
    rng = random.Random(8)
    code = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    word = lambda: "-".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(4))
    docs = {k: f"see {word()} token={code(200)} and {word()}/{word()}.html" for k in range(300)}
    docs |= {1000: f"x {code(200)} y", 1001: f"KEY_FILE={code(200)}", 1002: f"x {code(201)} y", 1003: f"x {'-'.join(word() for _ in range(9))} y", 1004: code(600)}
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(4)
    assert secrets.learn(frame).longest == 200
    got = {r.doc_id: r.spans for r in secrets.scan(frame).where("n_format > 0").collect()}
    assert got == {1000: "format:2:202", 1001: "format:9:209"}
    assert [secrets._doublings(n) for n in (1, 128, 129, 256, 257, 512, 513)] == [0, 0, 1, 1, 2, 2, 3]
