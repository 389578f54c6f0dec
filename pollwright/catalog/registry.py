"""Collects queries and their SQL under one name each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollwright.catalog.fixtures import Tables, duckdb_with
from pollwright.session import cut, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] = (), oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL that gives the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duckdb_with(list(views), oracle)
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


def placed(df: DataFrame) -> DataFrame:
    """Rows with their ``place`` in the order in which they come, so that a comparison of rows
    also compares the order. One number per partition is summed, never a row."""
    rows = cut(df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    place = (F.col("_start") + F.col("_row") - F.col("_first") + 1).alias("place")
    return rows.join(parts, "_part").select(*df.columns, place)
