"""Interval cover of a bar cache (S4): what is held, what is missing, what stands in.

Ranges are whole days, both ends inclusive: ``(symbol, range_start, range_end)``.  Days bound every step:
after ranges with one start are reduced to the longest, a symbol has at most one row per day, and ranges
meet through the calendar years they touch (an equi join), so only overlapping ones are paired.
Rows with a null or with an end before the start hold no day and are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = ("range_start", "range_end")


def merged_cover(entries: DataFrame) -> DataFrame:
    """The union of the ranges per symbol: ``(symbol, range_start, range_end)``, overlapping and adjacent
    ranges joined."""
    longest = entries.where("symbol IS NOT NULL AND range_start <= range_end").groupBy("symbol", "range_start").agg(
        F.max("range_end").alias("range_end"))
    w = Window.partitionBy("symbol").orderBy("range_start")
    upto = F.max("range_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("range_start") <= F.date_add(upto, 1), 0).otherwise(1)
    marked = longest.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(w))
    return marked.groupBy("symbol", "_island").agg(
        F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("_island")


def _years(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("_year", F.explode(F.sequence(F.year(start), F.year(end))))


def overlaps(ranges: DataFrame, cover: DataFrame) -> DataFrame:
    """The parts of ``ranges`` that ``cover`` (disjoint per symbol) holds: the columns of ``ranges`` and
    ``part_start, part_end``.  A pair is met once, in the later of the years the two begin in."""
    held = _years(cover.select(F.col("symbol").alias("_held"), F.col("range_start").alias("_from"), F.col("range_end").alias("_to")),
                  "_from", "_to").withColumnRenamed("_year", "_held_year")
    wanted = _years(ranges.where("range_start <= range_end"), *RANGE)
    pairs = wanted.join(held, (F.col("symbol") == F.col("_held")) & (F.col("_year") == F.col("_held_year")))
    pairs = pairs.where("_from <= range_end AND _to >= range_start AND _year = greatest(year(range_start), year(_from))")
    return pairs.select(*ranges.columns, F.greatest("range_start", "_from").alias("part_start"), F.least("range_end", "_to").alias("part_end"))


def gaps(ranges: DataFrame, cover: DataFrame) -> DataFrame:
    """The parts of ``ranges`` that ``cover`` does not hold: the columns of ``ranges`` and ``part_start,
    part_end``.  Equal rows of ``ranges`` count once."""
    ranges = ranges.where("range_start <= range_end").distinct()
    # a part past the end closes the last gap
    ends = ranges.withColumn("part_start", F.date_add("range_end", 1)).withColumn("part_end", F.col("part_start"))
    w = Window.partitionBy(*ranges.columns).orderBy("part_start")
    after = F.coalesce(F.date_add(F.lag("part_end").over(w), 1), F.col("range_start"))
    found = overlaps(ranges, cover).unionByName(ends).withColumn("_after", after)
    return found.where(F.col("_after") < F.col("part_start")).select(
        *ranges.columns, F.col("_after").alias("part_start"), F.date_sub("part_start", 1).alias("part_end"))


def is_fresh(as_of: str | dt.datetime) -> Column:
    """A cached range is used when it ended before ``as_of`` or was written less than one whole day before."""
    moment = F.lit((as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(as_of)).isoformat(sep=" ")).cast("timestamp_ntz")
    age_days = F.floor(F.timestamp_diff("SECOND", F.col("written_at"), moment) / 86400)
    return (F.col("range_end") < F.to_date(moment)) | (age_days < 1)


def served(requests: DataFrame, entries: DataFrame, attempts: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """Where every day of every request comes from: ``symbol, range_start, range_end`` (the request),
    ``part_start, part_end, served_from``.

    ``cache``: a fresh entry (``written_at``) holds it.  The rest is to be fetched; ``fetched``: an attempt
    with ``ok`` did.  Where the fetch failed, any older entry stands in (``stale``); else ``missing``.
    """
    keys = ["symbol", *RANGE]
    requests = requests.select(*keys)
    fresh = merged_cover(entries.where(is_fresh(as_of)))

    def pieces(parts: DataFrame) -> DataFrame:
        return parts.select("symbol", F.col("range_start").alias("_start"), F.col("range_end").alias("_end"),
                            F.col("part_start").alias("range_start"), F.col("part_end").alias("range_end"))

    def named(parts: DataFrame, source: str) -> DataFrame:
        whole = parts if "_start" not in parts.columns else parts.drop(*RANGE).withColumnsRenamed({"_start": RANGE[0], "_end": RANGE[1]})
        return whole.select(*keys, "part_start", "part_end", F.lit(source).alias("served_from"))

    wanted = pieces(gaps(requests, fresh))
    got, every = merged_cover(attempts.where("ok")), merged_cover(entries)
    failed = gaps(wanted, got)
    failed = failed.drop(*RANGE).withColumnsRenamed({"part_start": RANGE[0], "part_end": RANGE[1]})
    return named(overlaps(requests.distinct(), fresh), "cache").unionByName(named(overlaps(wanted, got), "fetched")).unionByName(
        named(overlaps(failed, every), "stale")).unionByName(named(gaps(failed, every), "missing"))
