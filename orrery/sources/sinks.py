"""Sinks (S11-S13): forecast rows, landscape analysis and summary as files.

Writes are plain DataFrame writers to a folder the caller names (on a cluster,
a shared folder); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_forecast(path_df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Forecast rows, partitioned by scenario for scenario-wise reads."""
    w = path_df.repartition("scenario_id", "symbol").write.mode(mode)
    if fmt == "parquet":
        w.partitionBy("scenario_id").parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(fmt)


def stringify(df: DataFrame, keys=("scenario_id",)) -> DataFrame:
    """Every value cast to string (the reference stores ``str(v)``)."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in df.columns if c not in keys])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row; numbers stay numbers and NULLs are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
