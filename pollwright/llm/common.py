"""What the operators of this subpackage share: table access, lineage cuts, batch loops."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pollwright.llm

from pollwright.session import cut  # noqa: F401  (the operators take it from here)

# Task code travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(pollwright.llm)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Bytes that split words: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` with, where SQL can say it, the SQL for the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that the tasks of one Python worker share, such as a tokenizer with its memory.
    Task code is unpickled anew for every task, so it is kept outside of it."""
    kept = sys.modules.setdefault("pollwright_kept", ModuleType("pollwright_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
