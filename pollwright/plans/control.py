"""Who would hold power: House, Senate and Electoral College lotteries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.operators.aggregates import located_seats, seat_counts
from pollwright.operators.joins import attach_electors, carry_terms
from pollwright.operators.lottery import draw_electors, draw_winners, locate_winners, vote_slices
from pollwright.operators.results import (
    effective_year,
    exclude_states,
    fill_blank,
    party_major,
    senate_class_columns,
    state_district,
)
from pollwright.session import cut

HOUSE_RACE = ["year", "state_district"]
SENATE_RACE = ["year", "state_district", "class"]


def _rows(df: DataFrame) -> DataFrame:
    """DC out, blanks filled, race key. Lone candidates and those without votes are dealt with
    where the votes of the race are added up."""
    return state_district(fill_blank(exclude_states(df)))


def _house_slices(df: DataFrame) -> DataFrame:
    return vote_slices(_rows(df), HOUSE_RACE, ["candidate", "party"], contested=True, sized=True)


def house_winners(df: DataFrame, n: int = 200, seed: int = 42, undervote: str = "none") -> DataFrame:
    """One row per House candidate and replicate."""
    slices = _house_slices(df)
    keep = [*HOUSE_RACE, "candidate", "party", "count_win"]
    return party_major(draw_winners(slices, HOUSE_RACE, n, seed, undervote, keep))


def house_control(df: DataFrame, n: int = 200, seed: int = 42, undervote: str = "none") -> DataFrame:
    """Seats per year, major party and replicate: (year, party_major, replicate, seats, count_win).

    Races are drawn once per replicate and the winner is located. With ``undervote='all'`` a draw
    may elect every candidate, so all of them are listed.
    """
    by = ["year", "party_major"]
    if undervote != "none":
        return seat_counts(house_winners(df, n, seed, undervote), by)
    slices = cut(_house_slices(df))
    return located_seats(party_major(slices), party_major(locate_winners(slices, HOUSE_RACE, n, seed)), by, n)


def _senate_slices(df: DataFrame) -> DataFrame:
    """Slices of every Senate election. They are read several times, and are small: no replicates yet."""
    rows = senate_class_columns(_rows(df).withColumn("class", F.col("class").cast("int")))
    carried = ["state", "year_class", "actually_special"]
    ticket = ["candidate", "party_simplified", *carried]
    return cut(vote_slices(rows, SENATE_RACE, ticket, contested=True, sized=True))


def _sitting(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows of elections once per session of their term; special elections in ``slices`` cut terms."""
    return effective_year(carry_terms(rows, slices.where("actually_special")))


def senate_current(df: DataFrame) -> DataFrame:
    """Slices of every sitting candidate list per session, with terms carried forward.

    Terms are carried before the replicates are drawn: a copy uses the draws of the election
    it came from (``election_year``), so the order does not change the result and the carried
    table stays 200 times smaller.
    """
    slices = _senate_slices(df)
    return _sitting(slices, slices)


def senate_winners(df: DataFrame, n: int = 200, seed: int = 42, undervote: str = "none") -> DataFrame:
    """One row per sitting Senate candidate, session and replicate."""
    keep = ["eff_year", "state", "class", "candidate", "party_simplified", "count_win"]
    draw_key = ["election_year", "state_district", "class"]
    return draw_winners(senate_current(df), draw_key, n, seed, undervote, keep)


def senate_control(df: DataFrame, n: int = 200, seed: int = 42, undervote: str = "none") -> DataFrame:
    """Seats per session, party and replicate. The winner is located at the election and that one row
    is carried through its sessions; ``undervote='all'`` lists every candidate, as for the House."""
    by = ["eff_year", "party_simplified"]
    if undervote != "none":
        return seat_counts(senate_winners(df, n, seed, undervote), by)
    slices = _senate_slices(df)
    won = _sitting(locate_winners(slices, SENATE_RACE, n, seed), slices)
    return located_seats(_sitting(slices, slices), won, by, n)


def elector_lottery(
    pres: DataFrame, house: DataFrame, n: int = 200, seed: int = 42, undervote: str = "none"
) -> DataFrame:
    """Every elector draws by the state's votes: (year, candidate, replicate, electors).

    One draw per elector and replicate; ``undervote='all'`` lists every candidate, as for the House.
    """
    race, by = ["year", "state_po"], ["year", "candidate"]
    slices = attach_electors(vote_slices(pres, race, ["candidate"], sized=True), house)
    if undervote != "none":
        drawn = draw_electors(slices, race, "electors", n, seed, undervote)
        return drawn.groupBy(*by, "replicate").agg(F.sum("won").alias("electors"))
    slices = cut(slices)
    won = locate_winners(slices, race, n, seed, "electors")
    return located_seats(slices, won, by, n).drop("count_win").withColumnRenamed("seats", "electors")
