"""Text enrichment (U2-U4): topic prompts, batched text callables, landscape.

The reference sends prompts to a remote text service.  Here the service is an
injected callable ``client(prompt) -> str``, or a ``factory`` that builds one
in each task, run inside ``mapInArrow``, a few rows of a batch at a time; failures are captured per row as
text instead of failing the batch.  No network client is built in.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reply texts of the reference's topic lookup.
UNKNOWN_TOPIC = "Unknown topic: "
ERROR_ANALYZING = "Error analyzing "
ERROR_PREFIX = "Error: "
NO_CLIENT = "Analysis not available (no text client provided)"

# Default landscape texts used when no client is present (the
# first is worded without the company name).
DEFAULT_TEXTS = {
    "company_position": "The company dominates the AI chip market with its GPUs.",
    "ai_advancements": "Recent advances include larger multimodal models.",
    "agi_timeline": "Estimates range from 2030 to 2050 depending on definitions.",
}
LANDSCAPE_TOPICS = list(DEFAULT_TEXTS)
AI_SENTIMENT = 0.75


Client = Callable[[str], str]
ROWS_AT_ONCE = 64  # of an Arrow batch that a task holds as Python texts


def _map_client(df: DataFrame, factory: Callable[[], Client], on_error: Callable[[str, Exception], str],
                out: str = "response") -> DataFrame:
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string"

    def run(batches):
        client = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                replies = []
                for topic, prompt in zip(part.column("topic").to_pylist(), part.column("prompt").to_pylist()):
                    if prompt is None:
                        replies.append(None)
                        continue
                    try:
                        replies.append(str(client(prompt)))
                    except Exception as e:  # captured per row, the batch goes on
                        replies.append(on_error(topic, e))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def topic_batch_enrich(df: DataFrame, client: Client | None = None, factory: Callable[[], Client] | None = None) -> DataFrame:
    """Run a client over ``(topic, prompt)`` rows; a failure becomes
    ``"Error: <message>"`` for that row only.  ``factory`` is called once per task."""
    return _map_client(df, factory or (lambda: client), lambda t, e: f"{ERROR_PREFIX}{e}")


def topic_prompts(requests: DataFrame, prompts: DataFrame, client: Client | None = None,
                  factory: Callable[[], Client] | None = None) -> DataFrame:
    """Answer requested topics from a prompt table.

    No client: a fixed message.  Otherwise unknown topics get
    ``"Unknown topic: <topic>"``, known ones the client's reply, failures
    ``"Error analyzing <topic>: <message>"``.  Only the requested prompts pass
    the client; what is joined to the requests are its replies, not the texts.
    """
    if client is None and factory is None:
        return requests.select("topic", F.lit(NO_CLIENT).alias("response"))
    known = prompts.where("prompt IS NOT NULL").select("topic", "prompt")
    asked = known.join(requests.select("topic").distinct(), "topic", "left_semi")
    replies = _map_client(asked, factory or (lambda: client), lambda t, e: f"{ERROR_ANALYZING}{t}: {e}").select("topic", "response")
    return requests.select("topic").join(replies, "topic", "left").select(
        "topic", F.coalesce("response", F.concat(F.lit(UNKNOWN_TOPIC), F.col("topic"))).alias("response"))


BatchClient = Callable[[list[str]], list[str]]
REPLY = "key string, response string, ok boolean, run int"


def _ask_in_batches(factory: Callable[[], BatchClient], batch_size: int, run: int):
    def ask(batches):
        client = factory()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at: at + batch_size]
                prompts = part["prompt"].tolist()
                try:
                    replies = [(str(r), True) for r in client(prompts)]
                    if len(replies) != len(prompts):
                        raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                except Exception:  # the batch as a whole failed: each prompt alone, so that one cannot spoil the others
                    replies = []
                    for prompt in prompts:
                        try:
                            replies.append((str(client([prompt])[0]), True))
                        except Exception as e:
                            replies.append((f"{ERROR_PREFIX}{e}", False))
                yield pd.DataFrame({"key": part["key"].tolist(), "response": [r for r, _ in replies], "ok": [ok for _, ok in replies], "run": run})

    return ask


def read_replies(spark: SparkSession, store: str) -> DataFrame:
    """The newest reply per key, successful ones first: ``key, response, ok, run``."""
    kept = spark.read.schema(REPLY).parquet(store)
    best = kept.groupBy("key").agg(F.max_by(F.struct("response", "ok", "run"), F.struct("ok", "run")).alias("_r"))
    return best.select("key", "_r.*")


def resumable_enrich(rows: DataFrame, store: str, factory: Callable[[], BatchClient], *, batch_size: int = 32, rounds: int = 8,
                     retry_errors: bool = False) -> DataFrame:
    """U3 with batched calls and a reply table that outlives the job: ``rows`` (topic, prompt, ...) with
    ``response``, ``ok`` and ``run``, the number of the run that got the reply.

    A key is a hash of topic and prompt, so a changed prompt is asked again and equal rows are asked
    once.  Keys are dealt to ``rounds`` by their hash; a round is one job that asks the keys without a reply, in
    batches, and appends theirs to ``store`` (a folder in shared storage) when it ends.  A run that is
    ended mid-way has lost at most its current round: the next one asks only for what is missing, with
    ``retry_errors`` also for what had failed.  A task lost inside a round repeats its own part of it.  Null prompts are not asked.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x1f", F.coalesce("topic", F.lit("")), "prompt"), 256))
    spark.createDataFrame([], REPLY).write.mode("append").parquet(store)  # so that there is something to read
    before = read_replies(spark, store)
    run = before.agg(F.coalesce(F.max("run"), F.lit(0))).head()[0] + 1
    asked = keyed.where("prompt IS NOT NULL").select(F.col("_key").alias("key"), "prompt").dropDuplicates(["key"])
    done = before.where("ok") if retry_errors else before
    turn = F.pmod(F.xxhash64("key"), F.lit(rounds))
    missing = asked.join(done, "key", "left_anti")
    for (number,) in missing.select(turn).distinct().orderBy(turn).collect():  # at most ``rounds`` rows
        todo = missing.where(turn == number)
        todo.mapInPandas(_ask_in_batches(factory, batch_size, run), REPLY).write.mode("append").parquet(store)
    replies = read_replies(spark, store).withColumnRenamed("key", "_key")
    return keyed.join(replies, "_key", "left").drop("_key")


def landscape(horizon: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """U4: per scenario the sentiment placeholder, the 5-year probability
    and three texts — the client's responses when given, else the defaults."""
    out = horizon.select("scenario_id", F.lit(AI_SENTIMENT).alias("ai_sentiment"), "agi_probability")
    if responses is None:
        return out.select("*", *[F.lit(v).alias(k) for k, v in DEFAULT_TEXTS.items()])
    one = responses.groupBy().pivot("topic", LANDSCAPE_TOPICS).agg(F.min("response"))  # of several replies to a topic, the least
    one = one.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULT_TEXTS.items()])
    return out.crossJoin(F.broadcast(one))
