"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins here can meet one key that holds a large part of all rows. AQE splits such
# partitions; the forced form also applies when an aggregate follows on the same key.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings that the operators count on."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where that is unset, a folder in
    the warehouse, which all executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: computed once, and not again when an executor
    is lost. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes the files
    when nobody refers to them any more."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no one reads any more, wherever the folder lies."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


class Scratch:
    """Tables in the shared folder. Unlike a checkpoint, a table tells Spark its real size, so the
    estimates of a loop that joins a table with itself don't multiply from one round to the next."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, last: int = 0) -> None:
        """Delete all tables but the ``last`` ones."""
        kept = len(self.paths) - last
        for path in self.paths[:kept]:
            discard(self.spark, path)
        self.paths = self.paths[kept:]
