"""Weighted draws: every race decided by lot, each candidate with the chance of its votes.

A draw is a point between 0 and the race total. Each candidate owns a slice of that line,
and wins the replicate if the point lies in the slice. Slices need one running sum per race.
``draw_winners`` then lists every candidate in every replicate; where only winners count,
``locate_winners`` draws once per race and replicate and finds the slice through a grid.

Random numbers are md5 digests of (seed, draw, race). They are the same on every row of a
race and on every retry of a lost task, and any SQL engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.columns import digest, group_key, key_text, unit_interval


def _explode_draws(df: DataFrame, race: Sequence[str], n: int, seed: int, *extra: Column) -> DataFrame:
    """Columns ``replicate`` and ``u``; one digest serves four replicates."""
    return (
        df.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))))
        .withColumn("_hex", digest(seed, *extra, F.col("_draw").cast("string"), *key_text(race)))
        .withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(4)])))
        .withColumn("replicate", F.col("_draw") * 4 + F.col("_part"))
        .where(F.col("replicate") < n)
        .withColumn("u", unit_interval(F.col("_hex"), F.col("_part")))
        .drop("_draw", "_hex", "_part")
    )


def replicate_draws(races: DataFrame, race: Sequence[str], n: int = 200, seed: int = 42) -> DataFrame:
    """One uniform number per distinct race and replicate."""
    return _explode_draws(races.select(*race).distinct(), race, n, seed)


def vote_slices(
    df: DataFrame,
    race: Sequence[str],
    ticket: Sequence[str],
    votes: str = "candidatevotes",
    total: str = "totalvotes",
    contested: bool = False,
    sized: bool = False,
) -> DataFrame:
    """One row per ticket with its slice ``(below, upto]`` of the race's votes.

    ``contested`` does what ``fix_unopposed`` and ``drop_zero_votes`` would do before: the only row
    of a race gets a vote if it has less than one, and tickets without votes go. Row counts and
    votes of the race are at hand here, so the input is read once.

    Rows of the same ticket are added first. Inside a race tickets are ordered by the first
    three md5 digits, then by the ticket itself. The digits split even the largest race into
    up to 4,096 blocks, so the window over a race sees only block sums and the window inside
    a block sees only a small part of the race. The chances do not depend on the order.

    Also gives ``race_total`` (largest total of the race, or ``race_votes`` where no total above
    0 is known), ``race_votes`` (sum of its candidates) and ``count_win`` (1 for the most votes, on all that tie);
    with ``sized`` also ``race_tickets`` (number of its tickets), which ``locate_winners`` needs.
    """
    race, ticket = list(race), list(ticket)
    tickets = (
        df.groupBy(*race, *ticket)
        .agg(
            F.coalesce(F.sum(votes), F.lit(0)).alias("votes") if contested else F.sum(votes).alias("votes"),
            # The total of a contested race comes from the rows that stay.
            F.max(F.when(F.col(votes) != 0, F.col(total)) if contested else F.col(total)).alias("_total"),
            F.max(total).alias("_any_total"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn("_race", group_key(race))
        .withColumn("_block", F.substring(F.md5(F.concat_ws("|", *key_text(ticket))), 1, 3))
    )
    in_race = Window.partitionBy("_race")
    earlier = in_race.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        tickets.groupBy("_race", "_block")
        .agg(
            F.sum("votes").alias("_votes"),
            F.max("votes").alias("_top"),
            F.max("_total").alias("_max_total"),
            F.sum("_rows").alias("_n"),
            F.max("_any_total").alias("_max_any"),
            F.count(F.lit(1)).alias("_tickets"),
        )
        .select(
            "_race",
            "_block",
            F.coalesce(F.sum("_votes").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_votes").over(in_race).alias("race_votes"),
            F.max("_top").over(in_race).alias("_top"),
            F.max("_max_total").over(in_race).alias("_race_total"),
            F.sum("_n").over(in_race).alias("_race_rows"),
            F.max("_max_any").over(in_race).alias("_race_any"),
            F.sum("_tickets").over(in_race).alias("race_tickets"),
        )
    )
    # One partitioning serves the join and the window. Its size is set because the draws that
    # follow multiply the work of every row, which a size-based merge of partitions ignores.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tickets.repartition(width, "_race", "_block")
    inside = (
        Window.partitionBy("_race", "_block")
        .orderBy(*ticket)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("_start") + F.sum("votes").over(inside)
    # The ticket's own totals and row count change nothing here; using them keeps both branches
    # on the same ticket aggregate, so that Spark computes it once.
    known = F.greatest("_race_total", "_total")
    slices = spread.join(blocks, ["_race", "_block"]).select(
        *race,
        *ticket,
        "votes",
        (upto - F.col("votes")).alias("below"),
        upto.alias("upto"),
        "race_votes",
        F.when(known > 0, known).otherwise(F.col("race_votes")).alias("race_total"),
        (F.col("votes") == F.col("_top")).cast("int").alias("count_win"),
        "race_tickets",
        F.greatest("_race_any", "_any_total").alias("_any_total"),
        ((F.col("_race_rows") == 1) & (F.col("_rows") == 1) & (F.col("votes") < 1)).alias("_lone"),
    )
    if contested:
        lone = F.col("_lone")
        alone = {
            "votes": F.lit(1),
            "below": F.lit(0),
            "upto": F.lit(1),
            "race_votes": F.lit(1),
            "race_total": F.when(F.col("_any_total") > 0, F.col("_any_total")).otherwise(F.lit(1)),
            "count_win": F.lit(1),
        }
        slices = slices.withColumns(
            {c: F.when(lone, v.cast(slices.schema[c].dataType)).otherwise(F.col(c)) for c, v in alone.items()}
        ).where(F.col("votes") != 0)
    return slices.drop("_any_total", "_lone", *([] if sized else ["race_tickets"]))


def _inside(below: Column, upto: Column) -> Column:
    die = F.col("die")
    return (die <= upto) & ((die > below) | ((die == 0) & (below == 0)))


def _hit(undervote: str) -> Column:
    die = F.col("die")
    hit = _inside(F.col("below"), F.col("upto")) & (F.col("votes") > 0)
    if undervote == "all":
        return hit | (die > F.col("race_votes"))
    if undervote != "none":
        raise ValueError("undervote must be 'none' or 'all'")
    return hit


def draw_winners(
    slices: DataFrame,
    draw_key: Sequence[str],
    n: int = 200,
    seed: int = 42,
    undervote: str = "none",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Repeat every slice row per replicate with ``won`` 0 or 1."""
    keep = list(keep) if keep is not None else [c for c in slices.columns]
    drawn = _explode_draws(slices, draw_key, n, seed).withColumn("die", F.col("u") * F.col("race_total"))
    return drawn.select(*keep, "replicate", _hit(undervote).cast("int").alias("won"))


def lottery_winners(
    df: DataFrame,
    race: Sequence[str],
    ticket: Sequence[str] = ("candidate",),
    n: int = 200,
    seed: int = 42,
    undervote: str = "none",
    votes: str = "candidatevotes",
    total: str = "totalvotes",
) -> DataFrame:
    """(race, ticket, count_win, replicate, won): who holds each race in each replicate.

    If the race total exceeds the candidates' votes, a draw may fall beyond the last slice:
    nobody wins (``none``) or everybody does (``all``).
    """
    slices = vote_slices(df, race, ticket, votes, total)
    return draw_winners(slices, race, n, seed, undervote, [*race, *ticket, "count_win"])


# Cells of a race's grid; a race has no more than it has tickets.
CELLS = 65_536


def _cell(at: str) -> Column:
    """The grid cell of a point. It never falls where the point rises, so a point of a slice lies
    in one of the cells between those of the slice's ends, however the division rounds."""
    cells = F.least(F.col("race_tickets"), F.lit(CELLS))
    place = F.floor(F.col(at) / F.col("race_total") * cells)
    inside = F.greatest(F.lit(0).cast("bigint"), F.least(place, cells))
    return F.when(F.col("race_total") > 0, inside).otherwise(F.lit(0)).cast("bigint")


SMALL = 64  # tickets of a race whose slices are packed into one row


def locate_winners(
    slices: DataFrame, race: Sequence[str], n: int = 200, seed: int = 42, electors: str | None = None
) -> DataFrame:
    """The slices that win, each with its ``replicate``: the rows of ``draw_winners`` with ``won`` 1.

    There is one draw per race and replicate (with ``electors``, for each of that many electors),
    not one per candidate. A race of at most ``SMALL`` tickets is one row with its slices, beside which
    its draws are made, so they meet no shuffle. The line of a larger race is cut into as many equal
    cells as it has tickets; a slice is listed in the cells it touches, at most twice as many rows as
    there are tickets, and a draw meets only the slices of its cell, two on average whatever the
    votes. Cells spread the race over the tasks. ``slices`` come from ``vote_slices(sized=True)`` and
    are read three times. Draws beyond all slices elect nobody.
    """
    race = list(race)
    small = F.col("race_tickets") <= SMALL
    rest = [c for c in slices.columns if c not in race]
    packed = _once(slices.where(small), race, electors, F.collect_list(F.struct(*rest)).alias("_slices"))
    won = F.filter("_slices", lambda s: (s["votes"] > 0) & _inside(s["below"], s["upto"]))
    near = _draws(packed, race, n, seed, electors).select(*race, "replicate", F.explode(won).alias("_won"))
    near = near.select(*race, "_won.*", "replicate")

    large = slices.where(~small)
    drawn = _draws(_once(large, race, electors), race, n, seed, electors)
    drawn = drawn.select(group_key(race).alias("_race"), _cell("die").alias("_cell"), "replicate", "die")
    # Slices beyond the total are out of reach; without a total nothing can be said to be.
    reached = (F.col("votes") > 0) & F.coalesce(F.col("below") <= F.col("race_total"), F.lit(True))
    listed = (
        large.where(reached)
        .withColumn("_race", group_key(race))
        .withColumn("_cell", F.explode(F.sequence(_cell("below"), _cell("upto"))))
    )
    far = listed.join(drawn, ["_race", "_cell"]).where(_inside(F.col("below"), F.col("upto")))
    return near.unionByName(far.drop("_race", "_cell", "die"))


def _once(slices: DataFrame, race: list[str], electors: str | None, *more: Column) -> DataFrame:
    """One row per race with what its draws need."""
    names = ["race_total", "race_tickets", *([electors] if electors else [])]
    return slices.groupBy(*race).agg(*[F.max(c).alias(c) for c in names], *more)


def _draws(races: DataFrame, race: list[str], n: int, seed: int, electors: str | None) -> DataFrame:
    """The columns of ``races`` with ``replicate`` and ``die``, for each elector if there are some."""
    # A row becomes n draws, which a size-based merge of partitions ignores.
    width = int(races.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if electors:
        races = races.withColumn("elector", F.explode(F.sequence(F.lit(1), F.col(electors).cast("int"))))
        spread = races.repartition(width, *race, "elector")
        drawn = _explode_draws(spread, race, n, seed, F.lit("elector"), F.col("elector").cast("string"))
    else:
        drawn = _explode_draws(races.repartition(width, *race), race, n, seed)
    return drawn.withColumn("die", F.col("u") * F.col("race_total"))


def draw_electors(
    slices: DataFrame, race: Sequence[str], electors: str, n: int = 200, seed: int = 42, undervote: str = "none"
) -> DataFrame:
    """As ``draw_winners`` with one draw per elector of the race."""
    each = slices.withColumn("elector", F.explode(F.sequence(F.lit(1), F.col(electors).cast("int"))))
    drawn = _explode_draws(each, race, n, seed, F.lit("elector"), F.col("elector").cast("string"))
    drawn = drawn.withColumn("die", F.col("u") * F.col("race_total"))
    return drawn.withColumn("won", _hit(undervote).cast("int"))
