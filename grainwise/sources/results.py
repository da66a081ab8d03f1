"""Describing datasets, and writing results that can be read back a page at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.errors import ParamsInvalid
from grainwise.functions.exprs import quoted, ratio
from grainwise.functions.ranks import positions
from grainwise.profiling.evidence import column_evidence


def describe_dataset(df: DataFrame) -> DataFrame:
    """column, dtype, nulls, null_share, distinct."""
    e = column_evidence(df)
    return e.select("column", "dtype", "nulls", ratio(F.col("nulls"), F.col("rows")).alias("null_share"), "distinct")


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The same few rows on every run, whatever the partitioning: the first by hash."""
    return df.orderBy(F.xxhash64(*[quoted(c) for c in df.columns])).limit(n)


def write_result(df: DataFrame, path: str, order: list[tuple[str, bool]]) -> None:
    """A result as Parquet with its place in the order, counted across range partitions."""
    placed = positions(df, order)
    placed.drop("position_whole").write.mode("errorifexists").parquet(path)


def read_page(spark: SparkSession, path: str, start: int = 1, limit: int = 50, columns: list[str] | None = None,
              start_column: int = 0, column_limit: int | None = None) -> DataFrame:
    """Rows `start` to `start + limit - 1` of a written result, and a window of its columns."""
    if start < 1 or limit < 1:
        raise ParamsInvalid("a page starts at row 1 or later and holds at least one row")
    read = spark.read.parquet(path)
    names = columns or [c for c in read.columns if c != "position"]
    names = names[start_column:][:column_limit] if column_limit else names[start_column:]
    return read.where(F.col("position").between(start, start + limit - 1)).select("position", *[quoted(c) for c in names])
