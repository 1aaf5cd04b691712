"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def carry(df: DataFrame, **named: Column) -> DataFrame:
    """The input rows packed in one struct column, beside ``named`` expressions, so that an
    operator's own columns never clash with the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(n) for n, c in named.items()])


def carried(df: DataFrame, columns: list[str]) -> DataFrame:
    """The packed input columns again."""
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in columns])


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
