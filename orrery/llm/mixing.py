"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times one of its documents has to appear for the source to
hold its target share.  Each document draws its count by inverting the Poisson distribution at a
hash of its id and the seed, is exploded by that count, and the copies are shuffled globally by a
second hash.  Counts need no coordination between rows, so a hot source is never gathered.
A rate beyond ``PART_RATE`` is drawn in equal parts, each by a hash of its own, which add up to a Poisson
number again; so no distribution is longer than one of that rate.  Built-in Spark functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import ROW, carried, carry

PART_RATE = 100.0  # the largest rate that is drawn at once
BROADCAST_SOURCES = 2_000  # sources up to which their distributions, of at most 261 numbers each, are broadcast: 4.2 MB
SALTS = 64
HEX_DIGITS = 13  # 52 bits of a hash make a uniform number in [0, 1)


def drawn_count(seed: int) -> str:
    """The draw of a row: over all parts of its source's rate, how many steps of the distribution
    lie at or below a uniform number from the hash of id and seed, and from the second part on its number."""
    u = f"CAST(conv(substring(md5(concat_ws(':', _doc, '{seed}', IF(j = 0, NULL, j))), 1, {HEX_DIGITS}), 16, 10) AS BIGINT) / {float(16**HEX_DIGITS)!r}D"
    return f"aggregate(sequence(0L, _parts - 1), 0L, (t, j) -> t + aggregate(array({u}), 0L, (n, u) -> n + size(filter(_cdf, c -> c <= u))))"


# P(count <= k) of a part for k = 0, 1, ... until the tail is below the grid of the uniform numbers.
PARTS = f"CAST(greatest(ceil(rate / {PART_RATE}D), 1) AS BIGINT)"
CDF = """CASE WHEN rate > 0 THEN aggregate(
    sequence(1, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS INT)),
    named_struct('log', -rate, 'sum', exp(-rate), 'all', array(exp(-rate))),
    (s, k) -> named_struct('log', s.log + ln(rate) - ln(k), 'sum', s.sum + exp(s.log + ln(rate) - ln(k)),
                           'all', concat(s.all, array(s.sum + exp(s.log + ln(rate) - ln(k))))),
    s -> s.all) ELSE array() END"""


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_column: str = "source",
                 text_column: str = "text", epochs: float = 1.0) -> DataFrame:
    """One row per source (null is a source of its own): source, chars, rate.

    Sizes are characters.  ``weights`` gives target shares, scaled to add up to one over the sources
    present; a source it does not name gets none.  Without it all sources with text share alike.
    ``epochs`` times the present characters is the expected total.  A source without any character
    keeps rate ``epochs``: its rows weigh nothing.
    """
    sizes = docs.groupBy(F.col(source_column).cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.char_length(F.col(text_column)), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0))
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    return sizes.join(F.broadcast(total)).select(  # one row by construction
        "source", "chars",
        F.when(F.col("chars") > 0, F.lit(float(epochs)) * F.col("weight") * F.col("all_chars")
               / F.col("all_weight") / F.col("chars")).otherwise(F.lit(float(epochs))).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 0, id_column: str = "doc_id",
              source_column: str = "source") -> DataFrame:
    """Every input row (packed as ``_row``) as often as its draw says, with ``copy`` (from 0) and
    ``mix_key``, shuffled globally: dealt to partitions and sorted by the hash ``mix_key``.

    Rows with equal ids draw alike; null ids count as one id.  Sources not in ``rates`` get no copy.
    Extra columns are carried and never clash.  An empty table gives no rows.
    """
    doc = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = carry(docs, _doc=doc, _source=F.col(source_column).cast("string"))
    parts = rates.withColumn("_parts", F.expr(PARTS)).withColumn("rate", F.col("rate") / F.col("_parts"))
    cdfs = write_through(parts.select(F.col("source").alias("_rated"), "_parts", F.expr(CDF).alias("_cdf")), "mix-rates")
    if cdfs.count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(cdfs), F.col("_source").eqNullSafe(F.col("_rated")))
    else:  # every source in SALTS parts, so a hot one is not gathered in one task
        parts = cdfs.withColumn("_rated_part", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        met = rows.withColumn("_part", F.expr(f"pmod(xxhash64(_doc), {SALTS})")).join(
            parts, F.col("_source").eqNullSafe(F.col("_rated")) & (F.col("_part") == F.col("_rated_part")))
    drawn = met.withColumn(
        "_count", F.expr(drawn_count(seed))).where("_count > 0")
    copies = drawn.select(ROW, "_doc", F.explode(F.expr("sequence(0, CAST(_count AS INT) - 1)")).alias("copy"))
    keyed = copies.select(ROW, "copy", F.md5(F.concat_ws(":", F.col("_doc"), F.col("copy").cast("string"),
                                                       F.lit(f"order-{seed}"))).alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, epochs: float = 1.0) -> DataFrame:
    """The replicated rows with the input's columns only."""
    return carried(replicate(docs, source_rates(docs, weights, epochs=epochs), seed), docs.columns)


def mix_report(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The replicated whole documents with ``copy`` and ``mix_key``."""
    out = replicate(docs, source_rates(docs, weights), seed)
    return out.select(*[F.col(ROW).getField(c).alias(c) for c in docs.columns], "copy", "mix_key")
