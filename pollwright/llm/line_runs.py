"""Line dedup with levelled runs of line hashes, from DataFrame functions only.

A run is a table of line hashes, dealt by hash and sorted within its partitions, with the number
of documents of its batch that hold each. A new batch is dealt and sorted alike and merge-joined with
the runs, which don't move: hashes that no run has become a run of the lowest level, and the counts of
those that one has are kept as hits. So a hash lies in one run only. When a level has ``fan_out`` runs,
they are merged into one run of the next level, so every hash is rewritten once per level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwright.llm.common import BLANKS, cut
from pollwright.llm.fingerprints import keyed_texts
from pollwright.session import discard, scratch_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    # lower() is much faster, and the same where there is nothing but ASCII.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _UPPER.lower())
    )


def key_hash(key: Column) -> list[Column]:
    """128 bits in two columns, so that different lines don't meet."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_counts(docs: DataFrame, *by: Column, min_chars: int = 1) -> DataFrame:
    """``h1, h2, n`` (and the columns ``by``): in how many rows of ``docs`` each line occurs."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    exploded = docs.select(*by, F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    names = exploded.columns[:-1]
    return exploded.select(*names, *key_hash(F.col("key"))).groupBy(*names, "h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """The runs, by level, and the hits of later batches: tables in the shared folder, bucketed and
    sorted by hash, so a lost executor costs no run and a join reads them as they lie."""

    def __init__(self, min_docs: int, fan_out: int = 4):
        self.min_docs, self.fan_out = min_docs, fan_out
        self.levels: list[list[DataFrame]] = []
        self.hits: list[DataFrame] = []
        self.tables: list[tuple[SparkSession, str, str]] = []

    def _table(self, rows: DataFrame) -> DataFrame:
        """``rows``, one bucket a partition."""
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(spark, "line_run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        dealt = rows.repartition(parts, "h1", "h2").write.format("parquet").option("path", path)
        dealt.bucketBy(parts, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables.append((spark, name, path))
        return spark.table(name)

    def drop(self) -> None:
        """Delete all tables."""
        for spark, name, path in self.tables:
            spark.sql(f"drop table {name}")
            discard(spark, path)
        self.tables = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def meet(self, counts: DataFrame) -> DataFrame:
        """``h1, h2, n, known`` of a batch: whether a run has the hash."""
        parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met, known = counts.repartition(parts, "h1", "h2").withColumn("known", F.lit(False)), F.col("known")
        for i, run in enumerate(self.runs()):
            here = run.select("h1", "h2", F.lit(True).alias(f"in{i}")).hint("merge")
            met = met.join(here, ["h1", "h2"], "left")
            known = known | F.col(f"in{i}").isNotNull()
        return met.select("h1", "h2", "n", known.alias("known"))

    def add(self, counts: DataFrame) -> None:
        """One batch of ``h1, h2, n``, each hash once."""
        met = self._table(self.meet(counts))
        if self.levels:
            self.hits.append(met.where("known").select("h1", "h2", "n"))
        self._put(0, met.where("not known").select("h1", "h2", "n"))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            merged = self._table(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)

    @property
    def frequent(self) -> DataFrame:
        """``h1, h2`` of the hashes with ``min_docs`` documents in all batches."""
        every = reduce(DataFrame.unionByName, self.runs() + self.hits)
        return every.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("h1", "h2")


def find_frequent(docs: DataFrame, min_docs: int, batches: int = 6, min_chars: int = 1) -> DataFrame:
    """``h1, h2`` of the lines in at least ``min_docs`` rows, taken in as batches of documents."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    counts = cut(line_counts(docs, batch, min_chars=min_chars))
    runs = LineRuns(min_docs)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i).select("h1", "h2", "n"))
    found = cut(runs.frequent)
    runs.drop()
    return found


def without_frequent(docs: DataFrame, frequent: DataFrame, *more: Column, min_chars: int = 1) -> DataFrame:
    """``kid, kn, n_lines, dropped, kept_text`` and ``more`` per row: the numbers (from 1) of
    the lines whose key is frequent, and the other lines joined again."""
    texts = keyed_texts(docs, *more)
    key = ["kid", "kn", "h"]
    numbered = keyed_texts(docs).select(
        *key, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key")
    ).where(F.length("key") >= min_chars)
    found = (
        numbered.select(*key, "at", *key_hash(F.col("key")))
        .join(frequent, ["h1", "h2"])
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.col("at") + 1)).alias("dropped"))
    )
    joined = texts.join(found, key, "left")
    lines = lines_of(F.col("text"))
    # The runs of lines between dropped ones, so that the work grows with the lines alone.
    ends = F.concat(F.array(F.lit(0)), F.col("dropped"), F.array(F.size(lines) + 1))
    return (
        joined.withColumn("lines", lines)
        .withColumn("ends", ends)
        .withColumn(
            "parts",
            F.transform(
                F.sequence(F.lit(0), F.size("dropped")),
                lambda k: F.slice("lines", F.get("ends", k) + 1, F.get("ends", k + 1) - F.get("ends", k) - 1),
            ),
        )
        .select(
            "kid",
            "kn",
            *texts.columns[4:],
            F.size("lines").alias("n_lines"),
            F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten("parts"), "\n")).alias("kept_text"),
        )
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 6) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped, kept_text`` for every row of ``docs``.

    A line's key found in at least ``min_docs`` rows loses all its lines. Null and empty texts
    are one empty line, and empty keys are never dropped. Repeated rows count as documents of
    their own and get equal results; null ids stay null; other columns are not read; an empty
    table gives no rows. A hot line is counted before the shuffle, and the join that finds its
    lines is one that Spark splits.
    """
    found = without_frequent(docs, find_frequent(docs, min_docs, batches))
    return found.select(
        F.when(~F.col("kn"), F.col("kid")).alias("doc_id"),
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("dropped").cast("bigint").alias("n_dropped"),
        "dropped",
        "kept_text",
    )


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 6) -> DataFrame:
    """``docs`` with all its columns, the texts without their frequent lines and ``n_chars``, if
    there is one, counted anew. No row goes; null text stays null if nothing is dropped."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = without_frequent(docs, find_frequent(docs, min_docs, batches), row)
    changed = F.size("dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return found.select(
        *[
            F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c in new
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
