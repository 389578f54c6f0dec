"""Election result CSVs to one row shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pollwright.operators.results import filter_in
from pollwright.operators.standardize import import_election, standardize_by_mapping
from pollwright.sources.mappings import DEFAULT_MAPPINGS, read_mapping


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: no inference pass, and unused columns are never parsed."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_raw(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A result file, or a folder that ``write_table`` wrote. Folders partitioned by year give it as
    a number, so a choice of years leaves the other folders unread."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {format!r}")
    return spark.read.parquet(path) if format == "parquet" else read_csv_text(spark, path)


def _results(raw: DataFrame, party: str, *filters: Sequence | str | None) -> DataFrame:
    # A cast that can fail would hide the year from partition and row-group pruning.
    known = raw.schema["year"].dataType == IntegerType()
    rows = raw if known else raw.withColumn("year", F.col("year").try_cast("int"))
    return filter_in(rows, *filters).select(
        "year",
        "state",
        "office",
        "candidate",
        F.col(party).alias("party"),
        F.col("candidatevotes").try_cast("bigint").alias("votes"),
        F.col("totalvotes").try_cast("bigint").alias("total_votes"),
    )


def read_president(spark: SparkSession, path: str, years=None, states=None, format: str = "csv") -> DataFrame:
    return _results(read_raw(spark, path, format), "party_simplified", years, states)


def read_senate(spark: SparkSession, path: str, years=None, states=None, format: str = "csv") -> DataFrame:
    return _results(read_raw(spark, path, format), "party_simplified", years, states)


def read_house(
    spark: SparkSession, path: str, years=None, states=None, districts=None, format: str = "csv"
) -> DataFrame:
    """House files name the party in ``party``."""
    return _results(read_raw(spark, path, format), "party", years, states, districts)


def read_election(spark: SparkSession, path: str, office: str) -> DataFrame:
    """A result file of either generation in the office's standard schema."""
    return import_election(read_csv_text(spark, path), office)


def read_election_by_mapping(spark: SparkSession, path: str, office: str, mapping_path: str | None = None) -> DataFrame:
    """A result file standardised by a mapping document, the built-in one by default."""
    mappings = read_mapping(spark, mapping_path) if mapping_path else DEFAULT_MAPPINGS
    return standardize_by_mapping(read_csv_text(spark, path), office, mappings)
