"""Registered queries against their SQL, and the pipeline's stages one by one."""

import pytest

import corpus_pipeline
from orrery.catalog.check import compare, duck_connect
from orrery.catalog.common import Query
from orrery.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    result = compare(spark, duck_connect(SF), Query(name, QUERIES[name], ORACLES[name]), SF)
    assert result["ok"], result


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, fp string, _row string, kept boolean, slot long"
    prose = [" ".join(f"word{(7 * k + 3 * i * i) % 97}" for i in range(60 + k)) for k in range(12)]
    secret = "0123456789abcdef" * 3
    rows = [(k, t, "en", "ab"[k % 2], len(t), "w", "f", "r", True, 1) for k, t in enumerate(prose)]
    rows += [rows[3], rows[3], (None, prose[5], None, None, None, None, None, None, None, None), (None,) * 10, (40, "", "en", "a", 0, "w", "f", "r", False, 2),
             (41, None, "en", "a", None, "w", "f", "r", False, 2), (42, prose[6] + f" token={secret} and more", "en", None, 7, "w", "f", "r", None, None),
             (43, "long " * 30000 + prose[7], "en", "a", None, "w", "f", "r", None, 3)]
    docs = spark.createDataFrame(rows, schema)
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None).cache()
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        texts[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.select("doc_id", "text").collect())
        assert stage(spark, docs.limit(0), None).count() == 0
    good = texts["quality_rules"]
    assert {k for k, _ in good} == {*range(12), -1, 42} and len(good) == 16  # no null, empty or repeating text; copies stay
    kept = texts["simhash_dedup"]
    assert len({k for k, _ in kept}) == len(kept) < 16 and 3 in {k for k, _ in kept}
    assert not any(secret in t for _, t in texts["secret_scan"]) and len(texts["secret_scan"]) == len(kept)
    assert {t for _, t in texts["mix_sources"]} <= {t for _, t in texts["secret_scan"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, None)
    assert packed.where("piece = 0").count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), None).count() == 0
