"""The compass document: issue dimensions and mixture modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_SCHEMA = """
political_compass struct<
  dimensions: array<struct<name: string, description: string,
                           range: array<double>, labels: map<string, string>>>,
  model_config: struct<target_distribution: struct<
    n_modes: int, mode_centers: array<array<double>>,
    mode_weights: array<double>, mode_scale: double>>>
"""


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """dim, name, label, description, range, labels."""
    dims = _document(spark, path).select(F.posexplode("political_compass.dimensions").alias("dim", "d"))
    return dims.select(
        "dim",
        "d.name",
        F.initcap(F.replace("d.name", F.lit("_"), F.lit(" "))).alias("label"),
        "d.description",
        "d.range",
        "d.labels",
    )


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """mode_id, center, weight, scale; weights are rescaled to sum 1, uniform if absent."""
    target = _document(spark, path).select("political_compass.model_config.target_distribution.*")
    modes = target.select(
        F.col("mode_scale").alias("scale"),
        "mode_weights",
        F.posexplode("mode_centers").alias("mode_id", "center"),
    ).withColumn("weight", F.coalesce(F.get("mode_weights", "mode_id"), F.lit(1.0)))
    # One document, so this window holds only its few modes.
    total = F.sum("weight").over(Window.partitionBy())
    return modes.select(
        "mode_id", "center", (F.col("weight") / total).alias("weight"), F.coalesce("scale", F.lit(0.15)).alias("scale")
    )
