"""Sums, shares, pivots and distributions over result and seat tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.functions.columns import bin_index, share
from pollwright.functions.scale import with_group_stats
from pollwright.operators.results import presidential_years

# The parties of the Senate picture, and of the House picture.
SENATE_PARTIES = ["DEMOCRAT", "REPUBLICAN", "OTHER", "LIBERTARIAN"]
HOUSE_PARTIES = ["DEMOCRAT", "REPUBLICAN", "OTHER"]


def _sum_votes(df: DataFrame, *keys: str) -> DataFrame:
    """Sum of votes; rows with a null key are left out, all-null votes sum to 0."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"))


def votes_by_year(df: DataFrame) -> DataFrame:
    return _sum_votes(df, "year", "party")


def votes_by_state(df: DataFrame) -> DataFrame:
    return _sum_votes(df, "state", "party")


def votes_by_year_state(df: DataFrame) -> DataFrame:
    return _sum_votes(df, "year", "state", "party")


def mean_vote_shares(shares: DataFrame, keys=("year", "state")) -> DataFrame:
    """The mean share of each party per key, in long form: any number of parties."""
    return shares.dropna(subset=[*keys, "party"]).groupBy(*keys, "party").agg(F.avg("vote_share").alias("vote_share"))


def pivot_vote_shares(shares: DataFrame, parties: Sequence[str], keys=("year", "state")) -> DataFrame:
    """One row per key with the mean share of each listed party, 0 where it did not run.

    Keys where only other parties ran are left out. ``mean_vote_shares`` takes all parties.
    """
    parties = list(parties)
    kept = shares.dropna(subset=[*keys, "party"]).where(F.col("party").isin(parties))
    return kept.groupBy(*keys).pivot("party", parties).agg(F.avg("vote_share")).na.fill(0.0, subset=parties)


def district_shares(df: DataFrame, group_by: Sequence[str] = ("year", "state")) -> DataFrame:
    """Party shares of any grouping level, in long form.

    The total is taken to be the same on all rows of a group; the largest is used, so the
    result does not depend on row order.
    """
    summed = (
        df.dropna(subset=[*group_by, "party"])
        .groupBy(*group_by, "party")
        .agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"), F.max("total_votes").alias("total_votes"))
    )
    return summed.withColumn("vote_share", share(F.col("votes"), F.col("total_votes")))


def aggregate_district(
    df: DataFrame, parties: Sequence[str], group_by: Sequence[str] = ("year", "state")
) -> DataFrame:
    """Shares of the listed parties at any grouping level, in wide form."""
    return pivot_vote_shares(district_shares(df, group_by), parties, group_by)


def seat_counts(winners: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seats per group and replicate, with the seats by plain count beside them."""
    counts = [F.sum("won").alias("seats")]
    if "count_win" in winners.columns:
        counts.append(F.sum("count_win").alias("count_win"))
    return winners.groupBy(*by, "replicate").agg(*counts)


def located_seats(held: DataFrame, won: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """``seat_counts`` from the winners alone: ``held`` has every candidate once, for the groups that
    win nothing and the plain count, and ``won`` has one row per seat and replicate."""
    groups = held.groupBy(*by).agg(F.sum("count_win").alias("count_win"))
    none = groups.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("won", F.lit(0))
    seats = won.select(*by, "replicate", F.lit(1).alias("won"), F.lit(0).cast("bigint").alias("count_win"))
    return none.unionByName(seats).groupBy(*by, "replicate").agg(
        F.sum("won").alias("seats"), F.sum("count_win").alias("count_win")
    )


def seat_totals(seats: DataFrame, year: str = "year") -> DataFrame:
    """Seats of all parties per year and replicate: should equal the number of races."""
    return seats.groupBy(year, "replicate").agg(F.sum("seats").alias("seats"))


def seats_by_state(winners: DataFrame, year: str = "eff_year") -> DataFrame:
    return seat_counts(winners, [year, "state"])


def electors_by_state(house: DataFrame) -> DataFrame:
    """Distinct House districts per state in presidential years."""
    districts = presidential_years(house).select("year", "state_po", "district")
    return districts.groupBy("year", "state_po").agg(F.count_distinct("district").alias("electors"))


def _with_absent(seats: DataFrame, year: str, party: str, parties: Sequence[str], **extra: Column) -> DataFrame:
    """One more row per year and listed party with the given values, to make absent ones appear."""
    grid = seats.select(year).distinct().withColumn(party, F.explode(F.array(*[F.lit(p) for p in parties])))
    return seats.unionByName(grid.withColumns(extra), allowMissingColumns=True)


def seat_distribution(
    seats: DataFrame, parties: Sequence[str] = SENATE_PARTIES, year: str = "eff_year", party: str = "party_simplified"
) -> DataFrame:
    """Mean seats over the replicates beside the seats by plain count; absent parties are 0."""
    return (
        _with_absent(seats, year, party, parties)
        .groupBy(year, party)
        .agg(
            F.coalesce(F.avg("seats"), F.lit(0.0)).alias("mean_seats"),
            F.coalesce(F.max("count_win"), F.lit(0)).alias("count_win"),
        )
    )


def seat_histogram(
    seats: DataFrame, bins: int = 60, year: str = "eff_year", party: str = "party_simplified"
) -> DataFrame:
    """Replicates per seat bin and party; all parties of a year share the edges.

    Equal values widen the range by half a seat on both sides. Empty bins are listed with 0.
    """
    ranged = with_group_stats(
        seats.select(year, party, F.col("seats").cast("double").alias("seats")),
        [year],
        low=F.min("seats"),
        high=F.max("seats"),
    )
    flat = F.col("low") == F.col("high")
    edges = {
        "low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
        "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")),
    }
    placed = ranged.withColumns(edges).withColumn("width", (F.col("high") - F.col("low")) / bins)
    counted = placed.groupBy(
        year, party, "low", "width", bin_index(F.col("seats"), F.col("low"), F.col("width"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    empty = counted.select(year, party, "low", "width").distinct()
    empty = empty.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn(
        "n", F.lit(0).cast("bigint")
    )
    return (
        counted.unionByName(empty)
        .groupBy(year, party, "low", "width", "bin")
        .agg(F.sum("n").alias("n"))
        .select(
            year,
            party,
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("edge_low"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("edge_high"),
            "n",
        )
    )


def seat_stack(
    distribution: DataFrame,
    value: str = "count_win",
    year: str = "eff_year",
    party: str = "party_simplified",
    top: float = 100.0,
) -> DataFrame:
    """Lower and upper edge of each party's band: D, Other, Lib up from 0, R down from ``top``.
    Parties that have no band of their own are part of Other."""
    named = F.when(F.col(party).isin(SENATE_PARTIES), F.col(party)).otherwise("OTHER")
    distribution = distribution.withColumn(party, named)

    def seats_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(party) == name, F.col(value))), F.lit(0)).cast("double")

    yearly = distribution.groupBy(year).agg(*[seats_of(p).alias(p) for p in SENATE_PARTIES])
    dem, other, lib, rep = (F.col(p) for p in ("DEMOCRAT", "OTHER", "LIBERTARIAN", "REPUBLICAN"))
    bands = {
        "DEMOCRAT": (F.lit(0.0), dem),
        "OTHER": (dem, dem + other),
        "LIBERTARIAN": (dem + other, dem + other + lib),
        "REPUBLICAN": (top - rep, F.lit(top)),
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("party"), low.alias("lower"), high.alias("upper"))
            for name, (low, high) in bands.items()
        ]
    )
    return yearly.select(year, F.explode(rows).alias("b")).select(
        year, F.col("b.party").alias(party), "b.lower", "b.upper"
    )


def available_years_states(df: DataFrame) -> DataFrame:
    """Distinct years and states as (kind, value), in order. One scan."""
    values = F.array(
        F.struct(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")),
        F.struct(F.lit("state").alias("kind"), F.col("state").alias("value")),
    )
    return (
        df.select(F.explode(values).alias("v"))
        .select("v.kind", "v.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("kind", "value")
    )


def races_in_year(df: DataFrame, year: int) -> DataFrame:
    """Distinct race keys of one year."""
    return df.where(F.col("year") == year).select("state_district").distinct()


def race_wins(winners: DataFrame, year: int, race: str) -> DataFrame:
    """Wins over all replicates of every candidate of one race."""
    picked = winners.where((F.col("year") == year) & (F.col("state_district") == race))
    return picked.groupBy("year", "state_district", "candidate").agg(F.sum("won").alias("wins"))


def electoral_votes(pres: DataFrame) -> DataFrame:
    """All electors of a state to its top candidate, summed; equal tops go to the first name."""
    states = pres.groupBy("year", "state_po", "candidate").agg(
        F.sum("candidatevotes").alias("_votes"), F.max("electors").alias("electors")
    )
    tops = states.groupBy("year", "state_po").agg(
        F.min(F.struct((-F.col("_votes")).alias("v"), F.col("candidate"), F.col("electors"))).alias("top")
    )
    return tops.groupBy("year", F.col("top.candidate").alias("candidate")).agg(
        F.sum("top.electors").alias("electoral_votes")
    )
