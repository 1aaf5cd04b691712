"""Registered queries: topic prompts, batched text callables and the landscape
(U2-U4, S12).

Prompt texts come from ``documents`` (topic ``doc-<id>``); the prompt library
holds the English documents, requests are the labelled documents, so
non-English requests meet the unknown-topic rule.  The text client is a
deterministic stand-in that reports the prompt length and fails on
prompts that hold a marker; the whole text is always passed, whatever its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import arrival as A
from ..operators import enrich as E
from ..sources import scenarios as SC
from ..session import scratch_path
from ..sources.sinks import stringify, write_json
from .arrival import chain_sql, years_cte
from .common import dbl, register, table

MARKER = "***"
LAND_BASE = 2025


def make_client():
    """Builds a deterministic stand-in for a text service, once per task."""

    def counting_client(prompt: str) -> str:
        if MARKER in prompt:
            raise ValueError("prompt holds a marker")
        return f"chars={len(prompt)}"

    return counting_client


def prompts_of(spark, sf, english_only: bool):
    d = table(spark, sf, "documents")
    if english_only:
        d = d.filter(F.col("lang") == "en")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("topic"), F.col("text").alias("prompt"))


@register(
    "topic_batch_enrich",
    f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS topic,
               CASE WHEN contains(text, '{MARKER}') THEN '{E.ERROR_PREFIX}prompt holds a marker'
                    ELSE 'chars=' || CAST(length(text) AS VARCHAR) END AS response
        FROM documents""",
)
def q_topic_batch_enrich(spark, sf):
    """The client over every (topic, prompt); failures captured per row."""
    out = E.topic_batch_enrich(prompts_of(spark, sf, False), factory=make_client)
    return out.select("topic", "response")


@register(
    "topic_prompts",
    f"""SELECT 'doc-' || CAST(l.doc_id AS VARCHAR) AS topic,
               CASE WHEN d.doc_id IS NULL THEN '{E.UNKNOWN_TOPIC}doc-' || CAST(l.doc_id AS VARCHAR)
                    WHEN contains(d.text, '{MARKER}') THEN '{E.ERROR_ANALYZING}doc-' || CAST(l.doc_id AS VARCHAR) || ': prompt holds a marker'
                    ELSE 'chars=' || CAST(length(d.text) AS VARCHAR) END AS response
        FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id""",
)
def q_topic_prompts(spark, sf):
    """Labelled documents looked up in the English prompt library."""
    req = table(spark, sf, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("topic"))
    return E.topic_prompts(req, prompts_of(spark, sf, True), factory=make_client)


def make_batch_client():
    """Builds a deterministic stand-in for a batched text service: the words of each prompt and its
    longest one; a batch with a marked prompt fails as a whole."""

    def words_client(prompts: list[str]) -> list[str]:
        if any(MARKER in p for p in prompts):
            raise ValueError("prompt holds a marker")
        words = [p.replace("\n", " ").split(" ") for p in prompts]
        return [f"words={sum(1 for w in x if w)} longest={max(map(len, x), default=0)}" for x in words]

    return words_client


@register(
    "resumable_enrich",
    f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS topic,
               CASE WHEN contains(text, '{MARKER}') THEN '{E.ERROR_PREFIX}prompt holds a marker'
                    ELSE 'words=' || CAST(len(list_filter(w, lambda x: x <> '')) AS VARCHAR) || ' longest='
                         || CAST(list_max(list_transform(w, lambda x: length(x))) AS VARCHAR) END AS response,
               NOT contains(text, '{MARKER}') AS ok, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run
        FROM (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)""",
)
def q_resumable_enrich(spark, sf):
    """U3 resumed: a first run asks for the English documents, a second for all; it has to ask only
    for the rest, which the run number of each reply shows."""
    store = scratch_path(spark, f"replies-{uuid.uuid4().hex}")
    E.resumable_enrich(prompts_of(spark, sf, True), store, make_batch_client, rounds=2)
    return E.resumable_enrich(prompts_of(spark, sf, False), store, make_batch_client, rounds=2).select("topic", "response", "ok", "run")


def horizon_of(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.horizon_probability(A.posterior_moments(*SC.scenario_inputs(li, LAND_BASE)))


def landscape_of(spark, sf):
    return E.landscape(horizon_of(spark, sf))


@register(
    "landscape_defaults",
    "WITH "
    + chain_sql(LAND_BASE)
    + years_cte("ypl", 0, 15)
    + f"""
    SELECT scenario_id, {dbl(E.AI_SENTIMENT)} AS ai_sentiment, round(cumulative_probability, 6) AS agi_probability,
           {", ".join(f"'{v}' AS {k}" for k, v in E.DEFAULT_TEXTS.items())}
    FROM ypl WHERE year = {LAND_BASE + 5}""",
)
def q_landscape_defaults(spark, sf):
    """U4 without a client: sentiment, 5-year probability, default texts."""
    out = landscape_of(spark, sf)
    return out.withColumn("agi_probability", F.round("agi_probability", 6))


@register(
    "analysis_json_sink",
    "WITH "
    + chain_sql(LAND_BASE)
    + years_cte("ypl", 0, 15)
    + f"""
    SELECT scenario_id, '{E.AI_SENTIMENT}' AS ai_sentiment, round(cumulative_probability, 6) AS agi_probability,
           {", ".join(f"'{v}' AS {k}" for k, v in E.DEFAULT_TEXTS.items())}
    FROM ypl WHERE year = {LAND_BASE + 5}""",
)
def q_analysis_json_sink(spark, sf):
    """The landscape with every value as a string, written as JSON and read back."""
    out = stringify(landscape_of(spark, sf))
    path = scratch_path(spark, f"analysis-{uuid.uuid4().hex}")
    write_json(out, path)
    back = spark.read.schema(out.schema).json(path)
    return back.withColumn("agi_probability", F.round(F.col("agi_probability").cast("double"), 6))


TOPIC_LANGUAGES = dict(zip(E.LANDSCAPE_TOPICS, ("en", "de", "fr")))


@register(
    "landscape_with_client",
    "WITH "
    + chain_sql(LAND_BASE)
    + years_cte("ypl", 0, 15)
    + f""",
    stats AS (SELECT lang, 'Summarise ' || CAST(count(*) AS VARCHAR) || ' documents of ' || CAST(sum(n_chars) AS VARCHAR)
                           || ' characters' AS prompt FROM documents GROUP BY 1)
    SELECT scenario_id, {dbl(E.AI_SENTIMENT)} AS ai_sentiment, round(cumulative_probability, 6) AS agi_probability,
           {", ".join(f"coalesce((SELECT 'chars=' || CAST(length(prompt) AS VARCHAR) FROM stats WHERE lang = '{v}'), '{E.DEFAULT_TEXTS[k]}') AS {k}" for k, v in TOPIC_LANGUAGES.items())}
    FROM ypl WHERE year = {LAND_BASE + 5}""",
)
def q_landscape_with_client(spark, sf):
    """U4 with a client: one prompt per topic, made of all documents of a language; a topic without
    documents keeps its default text."""
    topic = F.coalesce(*[F.when(F.col("lang") == v, F.lit(k)) for k, v in TOPIC_LANGUAGES.items()])
    prompts = table(spark, sf, "documents").groupBy(topic.alias("topic")).agg(
        F.format_string("Summarise %d documents of %d characters", F.count("*"), F.sum("n_chars")).alias("prompt"))
    responses = E.topic_batch_enrich(prompts.where("topic IS NOT NULL"), factory=make_client)
    out = E.landscape(horizon_of(spark, sf), responses)
    return out.withColumn("agi_probability", F.round("agi_probability", 6))
