"""Ordered-series layout: bounded row blocks with halo rows.

Row-based windows (rolling means, lags, leads, exponential means) need the
rows of one series in order.  ``Window.partitionBy("symbol")`` would put a
whole series into one task, which breaks when one symbol holds a large share
of the data.  Instead every series is cut into blocks of about
``block_rows`` rows; each block also receives the ``back`` rows before it and
the ``ahead`` rows after it as *halo* copies, so every window frame that looks
at most ``back`` rows back and ``ahead`` rows forward is complete inside one
block.  Windows then run ``partitionBy(key, _blk)``: one shuffle for the whole
indicator set, and blocks of bounded size.

How rows get their block without a per-series window over the raw rows:

1. count rows per (key, chunk) where chunk is a coarse time bucket
   (``date_trunc(chunk_unit, order)``) — a small table, partially aggregated;
2. prefix sums over the chunk table give each chunk its first row ordinal
   ``_off``; ``_off div block_rows`` is the chunk's block;
3. chunks are also sent to all blocks whose frames reach into them (halo);
4. the rows join the (small) chunk map — AQE turns this into a broadcast join
   when the map is small at run time, a shuffle join otherwise — and are
   numbered inside their block: ``rn = _base + row_number() - 1``.

Chunks are atomic, so a block may exceed ``block_rows`` by one chunk.  Bars have one row per symbol and
order value, which bounds a chunk.  For ticks, ``max_chunk_rows`` splits denser chunks: while the rows
are counted, a mergeable quantile sketch of each chunk's order values is kept, and a chunk beyond the
limit is cut at 1,023 of its quantiles; the parts are counted exactly and take the chunk's place above.
Rows of one moment are told apart by a hash of the row, so even a chunk of one moment is split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_blk"        # block id inside a series
OWN = "_own"          # True for the block's own rows, False for halo copies
POS = "_p"            # 0-based position inside the block partition (incl. halo)
SUB = "_sb"           # sub-block of POS (POS div SUB_ROWS), used by the EMA scan
ORDINAL = "rn"        # 0-based ordinal of the row inside its whole series
LENGTH = "_n"         # rows in the whole series (from the chunk table)
SUB_ROWS = 32

PARTS = 1024          # parts of a dense chunk
TIE_BITS = 10         # of the hash that orders rows of one moment

INTERNAL = [BLOCK, OWN, POS, SUB, LENGTH, "_base", "_chunk", "_part", "_tie"]


@dataclass(frozen=True)
class Series:
    """Names of the series key and order columns."""

    key: str = "symbol"
    order: str = "bar_date"

    @property
    def w(self) -> Window:
        """Row order inside a laid-out block (same sort for every window below)."""
        return Window.partitionBy(self.key, BLOCK).orderBy(SUB, POS)

    def rows(self, n: int) -> Window:
        """Frame of the current row and the ``n - 1`` rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def sub(self) -> Window:
        return Window.partitionBy(self.key, BLOCK, SUB).orderBy(POS)

    @property
    def block(self) -> Window:
        return Window.partitionBy(self.key, BLOCK)


def split_dense(rows: DataFrame, series: Series, max_chunk_rows: int) -> DataFrame:
    """Add ``_tie`` (a hash of the row) and ``_part``: 0, or in chunks of more than ``max_chunk_rows`` rows the place
    among the quantiles of (order, tie).

    The quantiles' error is a ten-thousandth of the chunk, so a part has at most about 1.2 thousandths of it."""
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    rows = rows.withColumn("_tie", F.expr(f"pmod(xxhash64({columns}), {1 << TIE_BITS})"))
    # moment and tie as one number, from the chunk's day on so that a double holds it; zone-free moments stay so
    o = f"`{series.order}`"
    if rows.schema[series.order].dataType == T.TimestampType():
        place = f"unix_micros({o}) - unix_micros(_chunk)"
    else:
        ntz = f"CAST({o} AS TIMESTAMP_NTZ)"
        place = (f"datediff(CAST({o} AS DATE), CAST(_chunk AS DATE)) * 86400000000L + hour({ntz}) * 3600000000L + minute({ntz}) * 60000000L"
                 f" + CAST(extract(SECOND FROM {ntz}) * 1000000 AS BIGINT)")
    rows = rows.withColumn("_at", F.expr(f"shiftleft({place}, {TIE_BITS}) + _tie"))
    cuts = ", ".join(f"{k}D / {PARTS}" for k in range(1, PARTS))
    chunks = rows.groupBy(series.key, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"), F.expr(f"percentile_approx(_at, array({cuts}), 10000)").alias("_cuts"))
    dense = chunks.where(F.col("_rows") > max_chunk_rows).select(F.col(series.key).alias("_dkey"), F.col("_chunk").alias("_dchunk"), "_cuts")
    rows = rows.join(dense, F.col(series.key).eqNullSafe(F.col("_dkey")) & F.col("_chunk").eqNullSafe(F.col("_dchunk")), "left")
    rows, step = rows.withColumn("_part", F.lit(0)), PARTS // 2
    while step:  # a binary search: how many cuts lie at or below the row
        rows = rows.withColumn("_part", F.expr(f"_part + CASE WHEN _cuts IS NOT NULL AND get(_cuts, _part + {step - 1}) <= _at THEN {step} ELSE 0 END"))
        step //= 2
    return rows.drop("_at", "_cuts", "_dkey", "_dchunk")


def layout(
    df: DataFrame,
    series: Series = Series(),
    *,
    back: int = 1024,
    ahead: int = 32,
    block_rows: int = 1 << 16,
    chunk_unit: str = "month",
    max_chunk_rows: int | None = None,
) -> DataFrame:
    """Lay ``df`` out in halo'd row blocks; adds ``rn`` and the internal columns.

    ``back`` must cover the longest look-back of the windows used afterwards
    (1024 also makes the exponential means exact to double precision) and
    ``ahead`` the longest lead.  ``max_chunk_rows`` splits chunks with more rows (see above).
    """
    if back < 0 or ahead < 0:
        raise ValueError("halo sizes must not be negative")
    key, order = series.key, series.order
    # expressions as SQL text: one call into the JVM per column (this runs on
    # the driver for every series query)
    k, o = f"`{key}`", f"`{order}`"
    rows = df.withColumn("_chunk", F.expr(f"date_trunc('{chunk_unit}', CAST({o} AS TIMESTAMP))"))
    unit, ties = ["_chunk"], ""
    if max_chunk_rows is not None:
        rows, unit, ties = split_dense(rows, series, max_chunk_rows), ["_chunk", "_part"], ", _tie"

    counts = rows.groupBy(key, *unit).agg(F.count(F.lit(1)).alias("_cnt"))
    # one ordered pass over the (small) chunk table: offsets, and blocks numbered without gaps
    wc = f"PARTITION BY {k} ORDER BY {', '.join(unit)}"
    upto = f"OVER ({wc} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    c = counts.withColumn("_end", F.expr(f"sum(_cnt) {upto}")).withColumn("_off", F.expr("_end - _cnt"))
    c = c.withColumn("_slot", F.expr(f"_off div {block_rows}"))
    c = c.withColumn("_new", F.expr(f"CAST(coalesce(lag(_slot) OVER ({wc}) <> _slot, true) AS BIGINT)"))
    c = c.withColumn("_cblk", F.expr(f"sum(_new) {upto}"))
    c = c.withColumns(
        {
            "_before": F.expr(f"coalesce(lag(_cblk) OVER ({wc}), _cblk)"),
            "_after": F.expr(f"coalesce(lead(_cblk) OVER ({wc}), _cblk)"),
            LENGTH: F.expr(f"sum(_cnt) OVER (PARTITION BY {k})"),
        }
    )
    # A chunk goes to its own block and, as halo, to every block with a chunk that starts less than
    # ``back`` rows after its end or ends less than ``ahead`` rows before its start, however short the
    # blocks between.  A chunk's start is the end of the one before it, so both are sliding frames.
    last = f"max(_after) OVER (PARTITION BY {k} ORDER BY _end RANGE BETWEEN CURRENT ROW AND {back - 1} FOLLOWING)" if back else "_cblk"
    first = f"min(_before) OVER (PARTITION BY {k} ORDER BY _off RANGE BETWEEN {ahead - 1} PRECEDING AND CURRENT ROW)" if ahead else "_cblk"
    c = c.withColumns({"_first": F.expr(first), "_last": F.expr(last)})
    target = F.expr("transform(sequence(least(_first, _cblk), greatest(_last, _cblk)), b -> named_struct('b', b, 'own', b = _cblk))")
    chunk_map = c.select(key, *unit, "_off", LENGTH, F.explode(target).alias("_t")).select(
        key, *unit, "_off", LENGTH, F.col("_t.b").alias(BLOCK), F.col("_t.own").alias(OWN)
    )
    chunk_map = chunk_map.withColumn("_base", F.expr(f"min(_off) OVER (PARTITION BY {k}, {BLOCK})")).drop("_off")

    # hash-partition on (key, block) explicitly: rows arriving partitioned by
    # key alone would otherwise satisfy the window's clustering, leaving every
    # block of a hot key in one task
    chunk_map = chunk_map.withColumnsRenamed({key: "_mkey", "_chunk": "_mchunk", "_part": "_mpart"})
    same = F.col(key).eqNullSafe(F.col("_mkey")) & F.col("_chunk").eqNullSafe(F.col("_mchunk"))  # null keys and orders stay
    if max_chunk_rows is not None:
        same = same & (F.col("_part") == F.col("_mpart"))
    laid = rows.join(chunk_map, same).drop("_mkey", "_mchunk", "_mpart").repartition(key, BLOCK)
    laid = laid.withColumn(POS, F.expr(f"row_number() OVER (PARTITION BY {k}, {BLOCK} ORDER BY {o}{ties}) - 1"))
    return laid.withColumn(ORDINAL, F.expr(f"_base + {POS}")).withColumn(SUB, F.expr(f"{POS} div {SUB_ROWS}"))


def unlayout(df: DataFrame, keep_ordinal: bool = True, keep_length: bool = False) -> DataFrame:
    """Drop halo copies and internal columns (optionally keep ``rn`` and ``_n``)."""
    drop = [c for c in INTERNAL if not (keep_length and c == LENGTH)]
    out = df.filter(F.col(OWN)).drop(*drop)
    return out if keep_ordinal else out.drop(ORDINAL)


def over_series(
    df: DataFrame,
    build,
    series: Series = Series(),
    *,
    back: int = 1024,
    ahead: int = 32,
    block_rows: int = 1 << 16,
    chunk_unit: str = "month",
    max_chunk_rows: int | None = None,
    keep_ordinal: bool = False,
    keep_length: bool = False,
) -> DataFrame:
    """Run ``build(laid_out_df, series) -> DataFrame`` on the block layout and
    return the own rows only."""
    laid = layout(df, series, back=back, ahead=ahead, block_rows=block_rows, chunk_unit=chunk_unit, max_chunk_rows=max_chunk_rows)
    return unlayout(build(laid, series), keep_ordinal=keep_ordinal, keep_length=keep_length)


def col_or_name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
