"""From raw documents to packed windows: the stages, and their run over one table folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pollwright.llm import line_runs, mixing, packing, quality_lines, simhash_cover
from pollwright.llm.common import table
from pollwright.session import discard, scratch_dir, tune

# The shares of all expected tokens that low and toxic documents get; the clean ones have the rest.
MOST = {"low": 0.001, "toxic": 0.001}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field and the base rules keep."""
    return quality_lines.keep_quality(docs, quality_lines.fit_line_model(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    tune(spark)
    return line_runs.drop_frequent_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    tune(spark)
    return simhash_cover.keep_one(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to the shares in ``MOST``."""
    model = mixing.fit_domains(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))
    return mixing.thin_to_shares(docs, model, MOST)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("packing", pack_windows),
]

# The line field, the fingerprints, the fitted rates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and
    deleted when the next one is written."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            discard(spark, f"{folder}/{number - 1}")
    return docs
