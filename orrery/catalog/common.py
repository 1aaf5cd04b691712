"""Shared pieces of the query catalog: table loading, registry, SQL snippets."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bars import bars_from_events, bars_from_orders


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None  # DuckDB oracle; None -> rows-only check


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(table(spark, sf_dir, "orders"))


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"))


def dbl(x: float) -> str:
    """A DOUBLE literal for DuckDB (plain decimals would be DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


# --- SQL building blocks (DuckDB dialect) -----------------------------------

BARS_SQL = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS bar_date,
       arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
       count(*) AS volume
FROM orders GROUP BY 1, 2
"""

EVENT_BARS_SQL = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts,
       arg_min(value, {'t': ts, 'i': event_id}) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, {'t': ts, 'i': event_id}) AS close, count(*) AS volume
FROM events GROUP BY 1, 2
"""


def full_window_sql(agg: str, x: str, n: int, w: str = "w") -> str:
    """``agg(x)`` over the last n rows, NULL unless all n are non-null."""
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END)"


def ema_cte_sql(source: str, x: str = "close", spans=(12, 26), signal: int | None = 9,
                key: str = "symbol", order: str = "bar_date") -> str:
    """Recursive CTE with the exact EMA recursion (oracle for the block scan).

    ``source`` is a relation with ``key, order, x``; result ``ema_rec`` has
    ``key, rn, ema<span>...[, macd_signal]``.
    """
    alphas = [2.0 / (s + 1.0) for s in spans]
    names = [f"ema{s}" for s in spans]
    seed_cols = ", ".join(f"{x} AS {n}" for n in names)
    step_cols = [f"{dbl(a)} * n.{x} + {dbl(1 - a)} * e.{n}" for a, n in zip(alphas, names)]
    sig_seed, sig_step, sig_col = "", "", ""
    if signal is not None:
        sa = 2.0 / (signal + 1.0)
        sig_seed = f", {dbl(0.0)} AS macd_signal"
        sig_step = f", {dbl(sa)} * (({step_cols[0]}) - ({step_cols[1]})) + {dbl(1 - sa)} * e.macd_signal"
        sig_col = ", macd_signal"
    return f"""
numbered AS (
  SELECT {key}, {order}, {x}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}
),
ema_rec({key}, rn, {", ".join(names)}{sig_col}) AS (
  SELECT {key}, rn, {seed_cols}{sig_seed} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.{key}, n.rn, {", ".join(step_cols)}{sig_step}
  FROM ema_rec e JOIN numbered n ON n.{key} = e.{key} AND n.rn = e.rn + 1
)"""
