"""Helpers that keep work spread out when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.session import cut


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; the right keys are dropped.

    No hint is given: Spark broadcasts the right side when its measured size allows it and
    otherwise shuffles both, and AQE splits partitions of a hot key.
    """
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group aggregates as extra columns.

    A window over the keys would pull each whole group into one task. Here the groups are
    reduced map-side first and the result, one row per group, is joined back.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return null_safe_join(df, totals, keys)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Running sum within each group, in ``order``, without one task per group.

    Rows are range partitioned on (keys, order), so a large group spans many consecutive
    blocks. Block sums give every block its starting value, and a window inside
    (keys, block) does the rest. The blocks are a checkpoint, because both uses of the
    range partitioning must see the same one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order, *rest)])
    blocks = cut(ranged.withColumn("_block", F.spark_partition_id()).withColumn("_value", value))

    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_block_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_block_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order, *rest)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(blocks, starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .select(*df.columns, name)
    )


def pair_with_blocks(points: DataFrame, options: DataFrame, key: str, spread: str, block_rows: int = 512) -> DataFrame:
    """Every point beside every block of a table of options.

    Options are packed once into arrays of about ``block_rows`` structs (column ``_options``,
    null for a block that got none). A point is repeated once per block, not once per option,
    and the join key carries a salt taken from ``spread`` so that a block is met by many tasks.
    """
    options = cut(options)
    n_blocks = max(1, -(-options.count() // block_rows))
    salts = 64
    packed = (
        options.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int"))
        .groupBy("_block")
        .agg(F.collect_list(F.struct(*options.columns)).alias("_options"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        points.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .join(packed, ["_block", "_salt"], "left")
        .drop("_block", "_salt")
    )


COPIES = 65_536  # in a block


def repeat_rows(df: DataFrame, times: str, spread: str) -> DataFrame:
    """Every row as often as its column ``times`` says, without that column.

    A row can stand for any share of a table, so its copies are made in blocks by many tasks.
    Stating the number of partitions keeps Spark from joining blocks, which are small till then.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(COPIES).cast("bigint"))))
    blocks = blocks.repartition(parts, spread, "_first")
    last = F.least(F.col(times), F.col("_first") + COPIES) - 1
    return blocks.withColumn("_copy", F.explode(F.sequence("_first", last))).drop(times, "_first", "_copy")
