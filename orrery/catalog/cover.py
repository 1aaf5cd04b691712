"""Registered queries: interval cover of the bar cache.

Cache entries, requests and fetch attempts are derived from the order bars: an entry per symbol and
month over its busier days, and long entries every third year that reach past ``AS_OF`` (stale then);
a request per symbol and year; an attempt per symbol and quarter, half of which fail.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cover as C
from .common import BARS_SQL, orders_bars, register

AS_OF = "1997-06-01 12:00:00"
LONG_DAYS = 700


def entries_of(bars):
    month = bars.where("volume >= 2").groupBy("symbol", F.trunc("bar_date", "month").alias("_m")).agg(
        F.min("bar_date").alias("range_start"), F.max("bar_date").alias("range_end"))
    month = month.select("symbol", "range_start", "range_end", F.date_add("range_end", 1).alias("written"))
    long = bars.where("year(bar_date) % 3 = 1").groupBy("symbol", F.year("bar_date").alias("_y")).agg(F.min("bar_date").alias("range_start"))
    long = long.select("symbol", "range_start", F.date_add("range_start", LONG_DAYS).alias("range_end"), F.date_add("range_start", 1).alias("written"))
    both = month.unionByName(long).withColumn("written_at", F.col("written").cast("timestamp_ntz")).drop("written")
    return both.where(F.col("written_at") <= F.lit(AS_OF).cast("timestamp_ntz"))


def requests_of(bars):
    years = bars.groupBy("symbol", F.year("bar_date").alias("_y")).agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("b"))
    return years.select("symbol", F.date_add("a", 5).alias("range_start"), F.date_sub("b", 3).alias("range_end"))


def attempts_of(bars):
    quarter = bars.groupBy("symbol", F.trunc("bar_date", "quarter").alias("range_start")).agg((F.sum("volume") % 2 == 0).alias("ok"))
    return quarter.select("symbol", "range_start", F.date_sub(F.add_months("range_start", 3), 1).alias("range_end"), "ok")


_SQL = f"""WITH bars AS ({BARS_SQL}),
entries AS (
  SELECT symbol, range_start, range_end, CAST(range_end + 1 AS TIMESTAMP) AS written_at FROM (
    SELECT symbol, min(bar_date) AS range_start, max(bar_date) AS range_end FROM bars WHERE volume >= 2 GROUP BY symbol, date_trunc('month', bar_date))
  WHERE CAST(range_end + 1 AS TIMESTAMP) <= TIMESTAMP '{AS_OF}'
  UNION ALL
  SELECT symbol, a, a + {LONG_DAYS}, CAST(a + 1 AS TIMESTAMP) FROM (
    SELECT symbol, min(bar_date) AS a FROM bars WHERE year(bar_date) % 3 = 1 GROUP BY symbol, year(bar_date))
  WHERE CAST(a + 1 AS TIMESTAMP) <= TIMESTAMP '{AS_OF}'
),
requests AS (
  SELECT * FROM (SELECT symbol, min(bar_date) + 5 AS range_start, max(bar_date) - 3 AS range_end FROM bars GROUP BY symbol, year(bar_date))
  WHERE range_start <= range_end
),
attempts AS (
  SELECT symbol, CAST(q AS DATE) AS range_start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS range_end, ok
  FROM (SELECT symbol, date_trunc('quarter', bar_date) AS q, sum(volume) % 2 = 0 AS ok FROM bars GROUP BY 1, 2)
),
days AS (SELECT symbol, CAST(unnest(generate_series(DATE '1991-01-01', DATE '2004-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT symbol FROM bars)),
held AS (
  SELECT symbol, d, EXISTS (SELECT 1 FROM entries e WHERE e.symbol = days.symbol AND d BETWEEN e.range_start AND e.range_end) AS any_entry,
    EXISTS (SELECT 1 FROM entries e WHERE e.symbol = days.symbol AND d BETWEEN e.range_start AND e.range_end
            AND (e.range_end < DATE '{AS_OF[:10]}' OR floor(date_diff('second', e.written_at, TIMESTAMP '{AS_OF}') / 86400) < 1)) AS fresh,
    EXISTS (SELECT 1 FROM attempts t WHERE t.symbol = days.symbol AND t.ok AND d BETWEEN t.range_start AND t.range_end) AS got
  FROM days
)"""


@register("cache_cover", _SQL + """
SELECT symbol, min(d) AS range_start, max(d) AS range_end FROM (
  SELECT symbol, d, d - CAST(row_number() OVER (PARTITION BY symbol ORDER BY d) AS INTEGER) AS island FROM held WHERE any_entry)
GROUP BY symbol, island""")
def q_cache_cover(spark, sf):
    """The union of all cached ranges per symbol."""
    return C.merged_cover(entries_of(orders_bars(spark, sf)))


_PARTS = """
SELECT symbol, range_start, range_end, min(d) AS part_start, max(d) AS part_end{extra} FROM (
  SELECT *, d - CAST(row_number() OVER (PARTITION BY symbol, range_start, range_end{source} ORDER BY d) AS INTEGER) AS island FROM (
    SELECT r.*, h.d, CASE WHEN fresh THEN 'cache' WHEN got THEN 'fetched' WHEN any_entry THEN 'stale' ELSE 'missing' END AS served_from
    FROM requests r JOIN held h ON h.symbol = r.symbol AND h.d BETWEEN r.range_start AND r.range_end{only}))
GROUP BY symbol, range_start, range_end, island{source}"""


@register("cache_gaps", _SQL + _PARTS.format(extra="", source="", only=" WHERE NOT fresh"))
def q_cache_gaps(spark, sf):
    """The parts of each request that no fresh entry holds, to be fetched."""
    bars = orders_bars(spark, sf)
    return C.gaps(requests_of(bars), C.merged_cover(entries_of(bars).where(C.is_fresh(AS_OF))))


@register("cache_fallback", _SQL + _PARTS.format(extra=", served_from", source=", served_from", only=""))
def q_cache_fallback(spark, sf):
    """Where every requested day comes from; older entries stand in where a fetch failed."""
    bars = orders_bars(spark, sf)
    return C.served(requests_of(bars), entries_of(bars), attempts_of(bars), AS_OF)
