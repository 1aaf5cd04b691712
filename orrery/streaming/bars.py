"""Incremental bar ingestion with Structured Streaming.

The reference refreshes one ticker's bars by re-downloading a date range and
caching it as a file (S2-S4).  The Spark form is a stream: new order files
land in a folder, and every micro-batch writes the partial bars of its own
orders into the store.  A partial bar carries the order keys of its open and
close, so partial bars of one (symbol, day) merge in any order: a read is
complete up to the newest file, and files that arrive late count like any
other.  The stream keeps no state; a batch that is run again after a failure
replaces its own folder.

``compact_ingested`` merges a stream's batches into one folder named by the batches it stands for.  A reader
takes the widest such folder and the batches after it, so what it reads is whole before, while and after
folders are merged and removed.  The newest batch is left alone: only that one may be run again.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.bars import BAR_COLUMNS


def partial_bars(orders: DataFrame) -> DataFrame:
    """Daily bars of some orders with the keys of their first and last order."""
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("bar_date")).agg(
        F.min("o_orderkey").alias("open_key"),
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max("o_orderkey").alias("close_key"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """One partial bar per (symbol, day) from several."""
    return partials.groupBy("symbol", "bar_date").agg(
        F.min("open_key").alias("open_key"), F.min_by("open", "open_key").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max("close_key").alias("close_key"), F.max_by("close", "close_key").alias("close"),
        F.sum("volume").alias("volume"))


def merged_bars(partials: DataFrame) -> DataFrame:
    """One bar per (symbol, day) from its partial bars."""
    return partials.groupBy("symbol", "bar_date").agg(
        F.min_by("open", "open_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_key").alias("close"),
        F.sum("volume").alias("volume"),
    ).select(*BAR_COLUMNS)


PARTIAL = ("symbol string, bar_date date, open_key long, open double, high double, low double, close_key long, "
           "close double, volume long")
_NAME = re.compile(r"ingest=(?P<stream>[0-9a-f]+)-(?:(?P<first>\d+)\.\.)?(?P<last>\d+)$")


def _store(spark: SparkSession, path: str):
    """The file system of ``path``, and a function that makes its paths."""
    jvm = spark._jvm
    place = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}" if name else path)
    return place().getFileSystem(spark._jsc.hadoopConfiguration()), place


def _batches(spark: SparkSession, store: str) -> dict[str, list[tuple[int, int, str]]]:
    """Per stream its folders (last batch, first batch, name), by last batch; a merged folder's first is 0."""
    fs, place = _store(spark, store)
    out: dict[str, list[tuple[int, int, str]]] = {}
    if fs.exists(place()):
        for status in fs.listStatus(place()):
            name = status.getPath().getName()
            if m := _NAME.match(name):
                last = int(m["last"])
                out.setdefault(m["stream"], []).append((last, last if m["first"] is None else int(m["first"]), name))
    return {stream: sorted(folders) for stream, folders in out.items()}


def _merged_upto(folders: list[tuple[int, int, str]]) -> tuple[int, str | None]:
    """The last batch and the name of a stream's widest merged folder."""
    return max(((last, name) for last, _, name in folders if ".." in name), default=(-1, None))


def _current(folders: list[tuple[int, int, str]]) -> list[str]:
    """The names that together hold every batch once."""
    upto, merged = _merged_upto(folders)
    return ([merged] if merged else []) + [name for last, _, name in folders if last > upto and ".." not in name]


def _read(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    return spark.read.schema(PARTIAL).parquet(*[f"{store.rstrip('/')}/{n}" for n in names])


def read_ingested(spark: SparkSession, store: str) -> DataFrame:
    """All bars of a store that :func:`start_bar_ingest` fills, late files included; none if nothing
    has been written yet."""
    names = [name for folders in _batches(spark, store).values() for name in _current(folders)]
    return merged_bars(_read(spark, store, names) if names else spark.createDataFrame([], PARTIAL))


def compact_ingested(spark: SparkSession, store: str) -> int:
    """Merge every stream's batches but its newest one, and remove what the merged folders stand for.
    Returns how many folders were removed.  One compaction of a store runs at a time."""
    fs, place = _store(spark, store)
    removed = 0
    for stream, folders in _batches(spark, store).items():
        newest = max(last for last, _, name in folders)
        settled = [f for f in folders if f[0] < newest]
        names = _current(settled)
        if len(names) > 1:
            upto = max(last for last, _, name in settled)
            own = f"_compact-{uuid.uuid4().hex}"  # readers pass over names that start so
            merged_partials(_read(spark, store, names)).write.parquet(f"{store.rstrip('/')}/{own}")
            if not fs.rename(place(own), place(f"ingest={stream}-0..{upto}")):
                raise OSError(f"could not put {own} in its place")
            folders = [*folders, (upto, 0, f"ingest={stream}-0..{upto}")]
        upto, merged = _merged_upto(folders)
        for last, _, name in folders:
            if last <= upto and name != merged:
                fs.delete(place(name), True)
                removed += 1
    return removed


def start_bar_ingest(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, *,
                     once: bool = True, file_glob: str | None = None) -> StreamingQuery:
    """Add the partial bars of the order files in the folder ``source``
    (optionally only files matching ``file_glob``) to the store at ``store``.

    ``once=True`` processes what is there now and stops (a scheduled refresh);
    ``False`` keeps running with the default trigger.  Each order file must be
    given to one checkpoint only.
    """
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, batch_id: int) -> None:
        partial_bars(batch).write.mode("overwrite").parquet(f"{store}/ingest={stream}-{batch_id}")

    w = reader.parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w
    return w.start()
