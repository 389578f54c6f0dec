"""Survey CSVs: a header, a row of units, then one row per poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwright.functions.columns import extract, to_number

# Month pattern and column titles of the published poll files.
MONTH_PATTERN = r"(\d{4}\s+\w+)"
PERIOD_TITLE = "X.1"
PARTY_TITLES = {"Republicans": "republicans", "Independents": "independents", "Democrats": "democrats"}
LEANER_TITLES = {
    "Republicans/Republican leaners": "republican_leaners",
    "Democrats/Democratic leaners": "democratic_leaners",
}


def _read_polls(spark: SparkSession, path: str, titles: dict[str, str], source: str | None) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    # Titles carry a byte-order mark, blanks and dots, so they are replaced by position.
    clean = [c.lstrip("\ufeff").strip() for c in raw.columns]
    names = {PERIOD_TITLE: "_period", **titles}
    missing = [t for t in names if t not in clean]
    if missing:
        raise ValueError(f"missing columns {missing} in {path}")
    raw = raw.toDF(*[names.get(c, f"_unused_{i}") for i, c in enumerate(clean)])
    first_month = F.regexp_replace(extract("_period", MONTH_PATTERN), r"\s+", " ")
    values = list(titles.values())
    polls = raw.select(
        F.try_to_timestamp(first_month, F.lit("yyyy MMM")).cast("date").alias("date"),
        *[to_number(v).alias(v) for v in values],
        F.lit(source or path.rstrip("/").rsplit("/", 1)[-1]).alias("source"),
    )
    # The units row has neither a month nor a number.
    return polls.where(F.col("date").isNotNull() | F.coalesce(*values).isNotNull())


def read_party_survey(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """date, republicans, independents, democrats, source."""
    return _read_polls(spark, path, PARTY_TITLES, source)


def read_leaner_survey(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """date, republican_leaners, democratic_leaners, source."""
    return _read_polls(spark, path, LEANER_TITLES, source)
