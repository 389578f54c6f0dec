"""Running sums, race winners, keep-latest merge and the month grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.scale import running_sum, with_group_stats
from pollwright.operators.results import union_results
from pollwright.sources.schemas import SEAT_COLUMNS, check_office


def running_votes(df: DataFrame, race: Sequence[str], order: Sequence[str], votes: str = "candidatevotes") -> DataFrame:
    """Votes of a race added up in ``order``, which should tell its rows apart."""
    return running_sum(df, list(race), list(order), F.col(votes), "cumsum")


def count_winner(df: DataFrame, race: Sequence[str], votes: str = "candidatevotes") -> DataFrame:
    """``count_win`` 1 on every row that has the most votes of its race; ties give several."""
    topped = with_group_stats(df, list(race), _top=F.max(votes))
    won = F.coalesce(F.col(votes) == F.col("_top"), F.lit(False))
    return topped.withColumn("count_win", won.cast("int")).drop("_top")


def attach_race_totals(df: DataFrame, race: Sequence[str], total: str = "totalvotes") -> DataFrame:
    """The largest total of the race on each of its rows."""
    return with_group_stats(df, list(race), race_total=F.max(total))


def merge_keep_latest(
    old: DataFrame, new: DataFrame, office: str, keys: Sequence[str] | None = None, sequence: Sequence[str] = ()
) -> DataFrame:
    """Union with one row per key: new beats old, then the last in ``sequence``.

    Spark keeps the best row per key map-side before the shuffle (a window group limit), so
    many copies of one key do not meet in one task. Rows that tie are told apart by their
    remaining columns, which makes the result repeatable.
    """
    keys = list(keys or ["year", "state", "candidate", "party", *SEAT_COLUMNS[check_office(office)]])
    both = union_results(
        old.withColumn("_source", F.lit(0)), new.withColumn("_source", F.lit(1))
    )
    rest = [c for c in both.columns if c not in keys and c not in sequence and c != "_source"]
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ("_source", *sequence, *rest)])
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_source")


def interpolate_monthly(
    df: DataFrame, date: str, values: Sequence[str], series: Sequence[str] = (), freq: str = "M"
) -> DataFrame:
    """Fill the month grid (or day grid, ``freq='D'``) between the first and last date of a series.

    Values are linear by position between known neighbours, the last one is carried to the
    end, and a gap at the start stays null. Rows of the same date are averaged first, so the
    windows see at most one row per calendar date and series, whatever the data size.
    """
    step, unit = {"M": ("month", "month"), "D": ("day", "day")}[freq]
    keys = list(series)
    known = (
        df.where(F.col(date).isNotNull())
        .groupBy(*keys, F.date_trunc(unit, date).cast("date").alias(date))
        .agg(*[F.avg(v).alias(v) for v in values])
    )
    span = known.groupBy(*keys).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    grid = span.select(
        *keys, F.explode(F.sequence("_from", "_to", F.expr(f"interval 1 {step}"))).alias(date)
    )
    # A union and a group-by fill the grid without a join.
    filled = (
        known.unionByName(grid, allowMissingColumns=True)
        .groupBy(*keys, date)
        .agg(*[F.max(v).alias(v) for v in values])
    )
    in_order = Window.partitionBy(*keys).orderBy(date)
    before = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The same running frame from the other end: a frame that starts at the current row would
    # be read anew for every row.
    after = Window.partitionBy(*keys).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = filled.withColumn("_at", F.row_number().over(in_order))
    for v in values:
        spot = F.when(F.col(v).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(v).alias("v")))
        placed = placed.withColumn(f"_{v}_left", F.last(spot, ignorenulls=True).over(before)).withColumn(
            f"_{v}_right", F.last(spot, ignorenulls=True).over(after)
        )
    out = []
    for v in values:
        left, right = F.col(f"_{v}_left"), F.col(f"_{v}_right")
        part = (F.col("_at") - left["at"]) / (right["at"] - left["at"])
        out.append(
            F.when(F.col(v).isNotNull(), F.col(v))
            .when(left.isNull(), None)
            .when(right.isNull(), left["v"])
            .otherwise(left["v"] + (right["v"] - left["v"]) * part)
            .alias(v)
        )
    return placed.select(*keys, date, *out)
