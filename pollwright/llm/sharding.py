"""Sharding by extendible hashing.

Documents get 60 hash bits. A bucket is named by a prefix of the bits, the directory starts with
the empty prefix, and a bucket above the byte limit is split on its next bit until every bucket
fits. Splitting top down ends at the shortest prefix of a document's bits whose bucket fits, so
whole levels are found at once from byte sums per prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.scale import running_sum
from pollwright.llm.common import cut

HASH_BITS = 60
COPIES = 65_536  # in a block


def _prefix(bits, length):
    """A prefix as text, one character a bit."""
    return F.when(length == 0, F.lit("")).otherwise(F.lpad(F.bin(bits), length.cast("int"), "0"))


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, copy, hash`` per row. Rows equal in id and size are numbered by
    ``copy``, which is part of the hashed name, so no group of rows shares its bits."""
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint").alias("n_bytes"),
    )
    copies = sizes.groupBy("doc_id", "n_bytes").agg(F.count("*").alias("n"))
    # A group can hold any share of the rows, so its copies are made by many tasks, block by block.
    # Stating the number of partitions keeps Spark from joining blocks, which are small till then.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = copies.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))))
    blocks = blocks.repartition(parts, "doc_id", "n_bytes", "first")
    last = F.least("n", F.col("first") + COPIES) - 1
    one = blocks.select("doc_id", "n_bytes", F.explode(F.sequence("first", last)).alias("copy"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_bytes", "copy")
    return one.withColumn("hash", F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint"))


def directory(cells: DataFrame, leaves: DataFrame, depth: int, block_bits: int) -> DataFrame:
    """``cell, leaf`` for every cell of ``depth`` bits that lies in a leaf.

    A leaf covers consecutive cells. Cells and leaves are sorted inside blocks of 2^block_bits
    cells, a leaf once per block that it covers, so no task holds more than a block.
    """
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
    leaf = F.struct("depth", "prefix", "shard_bytes", "shard_docs", last.alias("last")).alias("leaf")
    pieces = leaves.select(first.alias("first"), leaf).select(
        "first", "leaf", F.explode(F.sequence(F.shiftright("first", block_bits), F.shiftright("leaf.last", block_bits))).alias("block")
    )
    starts = pieces.select(
        "block", F.greatest("first", F.shiftleft("block", block_bits)).alias("cell"), F.lit(False).alias("wanted"), "leaf"
    )
    wanted = cells.select(F.shiftright("cell", block_bits).alias("block"), "cell", F.lit(True).alias("wanted"))
    upto = Window.partitionBy("block").orderBy("cell", "wanted").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = wanted.unionByName(starts, allowMissingColumns=True).withColumn("leaf", F.last("leaf", ignorenulls=True).over(upto))
    return placed.where(F.col("wanted") & (F.col("cell") <= F.col("leaf.last"))).select("cell", "leaf")


def extendible_shards(docs: DataFrame, max_bytes: int, level_bits: int = 16) -> DataFrame:
    """``doc_id, n_bytes, copy, shard, depth, shard_bytes, shard_docs`` for every row.

    ``shard`` is the bucket's bit prefix. No shard is above ``max_bytes``, but for a document
    that alone is larger: it has a shard of its own, named by all its bits, and isn't counted in
    any other. ``level_bits`` levels are settled per round over at most 2^level_bits cells; the
    next round takes only the documents of cells that still are too large.

    Null text has no bytes, null ids are hashed as such, repeated rows are spread like others,
    other columns are not read, and an empty table gives no rows. Texts are not moved.
    """
    rows = cut(hashed(docs))
    alone = rows.where(F.col("n_bytes") > max_bytes).select(
        "doc_id",
        "n_bytes",
        "copy",
        _prefix(F.col("hash"), F.lit(HASH_BITS)).alias("shard"),
        F.lit(HASH_BITS).alias("depth"),
        F.col("n_bytes").alias("shard_bytes"),
        F.lit(1).cast("bigint").alias("shard_docs"),
    )
    done, open_rows = alone, rows.where(F.col("n_bytes") <= max_bytes)
    start = 0
    while True:
        depth = min(start + level_bits, HASH_BITS)
        open_rows = open_rows.withColumn("cell", F.shiftright("hash", HASH_BITS - depth))
        cells = open_rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - depth)")
        )
        # At the last bit nothing can be split; only rows equal in all bits could be together there.
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("depth") == HASH_BITS)
        buckets = levels.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")
        )
        # A shard is a bucket that fits and came out of one that doesn't.
        split = buckets.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = buckets.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        top = fitting.where(F.col("depth") == start)
        below = fitting.join(split, ["depth", "parent"]).select(*top.columns)
        leaves = cut(directory(cells, top.unionByName(below), depth, min(level_bits, 10)))
        placed = open_rows.join(leaves, "cell").select(
            "doc_id",
            "n_bytes",
            "copy",
            _prefix(F.col("leaf.prefix"), F.col("leaf.depth")).alias("shard"),
            "leaf.depth",
            "leaf.shard_bytes",
            "leaf.shard_docs",
        )
        done = done.unionByName(placed)
        if depth == HASH_BITS:
            return done
        rest = cut(open_rows.join(leaves, "cell", "left_anti"))
        if rest.isEmpty():
            return done
        open_rows, start = rest.drop("cell"), depth


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """The rows of ``docs`` as Parquet folders, one per shard.

    Rows equal in id and size are numbered by many tasks, in the order they are read; the numbers
    are a checkpoint, so a task that is run again writes the same rows. Columns must be orderable.
    """
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(
        row,
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size.alias("n_bytes"),
        F.monotonically_increasing_id().alias("at"),
    )
    numbered = running_sum(rows, ["doc_id", "n_bytes"], ["at"], F.lit(1), "number").withColumn("copy", F.col("number") - 1)
    to = shards.select(F.col("doc_id").alias("d"), F.col("n_bytes").alias("b"), F.col("copy").alias("c"), "shard")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("n_bytes") == F.col("b")) & (F.col("copy") == F.col("c"))
    placed = numbered.join(to, on).select("row.*", F.concat(F.lit("b"), "shard").alias("_shard"))
    placed.repartition("_shard").write.partitionBy("_shard").parquet(path)
