"""The training-data pipeline: quality rules, SimHash near-dedup, secret scans, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and reread as the next one's docs.  All but the last return the
columns of ``documents``.

For all stages: an empty table gives an empty one; null ids, sources and other columns stay as they are; extra
columns are carried through the first four stages whatever their names, and not read by the last; what
null, empty and repeated texts come to is said at each.
"""

from __future__ import annotations

import uuid

from orrery.llm import mixing, packing, quality, secrets, simhash
from orrery.llm.common import read_table
from orrery.session import scratch_path


def quality_rules(spark, docs, sf_dir):
    """The documents judged good.  Null and empty texts have no words and go; repeated rows stay or go alike."""
    return quality.keep_good(docs)


def simhash_dedup(spark, docs, sf_dir):
    """One row of each group of near duplicates: that with the smallest id, of rows with that id the first
    written; a group without ids keeps one row.  Null and empty texts are one group."""
    return simhash.keep_representatives(docs)


def secret_scan(spark, docs, sf_dir):
    """All rows, the values of found secrets replaced in their texts, ``n_chars`` of changed ones set anew.
    Null texts stay null; repeated rows are changed alike."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Every row as often as its draw says, so that all sources hold equal shares of the characters.
    A null source is a source; rows with equal ids draw alike, null ids as one; null and empty texts
    weigh nothing, and a source of only such is drawn at rate one."""
    return mixing.mix(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of all rows in sequences of at most 2048 ids; copies are packed each, a null or empty text is
    one piece that holds the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

# The votes' estimate, XXH64 fingerprints, inferred automata and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
