from __future__ import annotations

import datetime

import pytest

from pollwright.operators import aggregates as agg
from pollwright.operators import joins
from pollwright.operators import results as res
from pollwright.operators import windows as win

D = datetime.date


def test_unopposed_and_null_keys(spark):
    df = spark.createDataFrame(
        [
            (2000, None, "1", "a", 0.0),
            (2000, "X", "1", "b", 0.0),
            (2000, "X", "1", "c", 0.0),
            (2000, "Y", "1", "d", 9.0),
            (2000, "Z", "1", "e", None),
        ],
        "year int, state string, district string, candidate string, candidatevotes double",
    )
    rows = {r["candidate"]: r for r in res.fix_unopposed(df, ["year", "state", "district"]).collect()}
    assert {c: (r["candidatevotes"], r["unopposed"]) for c, r in rows.items()} == {
        "a": (1.0, 1), "b": (0.0, 0), "c": (0.0, 0), "d": (9.0, 0), "e": (1.0, 1)
    }


def test_fill_blank_keeps_numbers(spark):
    df = spark.createDataFrame(
        [(None, None, None, None)], "party string, candidate string, candidatevotes double, other int"
    )
    assert res.fill_blank(df).first().asDict() == {"party": "", "candidate": "Blank", "candidatevotes": 0.0, "other": None}


def test_shares_of_empty_race(spark):
    df = spark.createDataFrame([(2000, "X", "P", 0, 0)], "year int, state string, party string, votes long, total_votes long")
    assert res.vote_shares(df).first()["vote_share"] is None


def test_votes_with_null_key_and_all_null_votes(spark):
    df = spark.createDataFrame([(2000, None, 5), (2000, "P", None), (None, "P", 7)], "year int, party string, votes long")
    assert [tuple(r) for r in agg.votes_by_year(df).collect()] == [(2000, "P", 0)]


def test_count_winner_ties(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "c", 1), (None, "d", 2)], "race int, candidate string, candidatevotes int")
    won = {r["candidate"]: r["count_win"] for r in win.count_winner(df, ["race"]).collect()}
    assert won == {"a": 1, "b": 1, "c": 0, "d": 1}


def test_year_class_of_odd_years(spark):
    df = spark.createDataFrame(
        [(y, 1, "TRUE") for y in (1976, 1977, 1978, 1979, 1980, 1981, 1982)], "year int, class int, special string"
    )
    rows = {r["year"]: r for r in res.senate_class_columns(df).collect()}
    assert [rows[y]["year_class"] for y in sorted(rows)] == [1, 1, 2, 2, 3, 3, 1]
    assert [rows[y]["actually_special"] for y in sorted(rows)] == [False, False, True, True, True, True, False]


def test_newer_than_and_drop_last_years(spark):
    old = spark.createDataFrame([(2000, "o"), (2002, "o")], "year int, src string")
    new = spark.createDataFrame([(2002, "n"), (2004, "n")], "year int, src string")
    rows = sorted(tuple(r) for r in res.newer_than(new, old).collect())
    assert rows == [(2000, "o"), (2002, "o"), (2004, "n")]
    assert res.newer_than(new, old.limit(0)).count() == 2
    years = spark.createDataFrame([(y,) for y in (1, 1, 2, 3, 4, 5)], "eff_year int")
    assert sorted(r[0] for r in res.drop_last_years(years).collect()) == [1, 1, 2]
    assert res.drop_last_years(years.where("eff_year < 3")).count() == 0


def test_merge_new_beats_old_then_sequence(spark):
    schema = "year int, state string, candidate string, party string, district string, seq int, candidatevotes int"
    old = spark.createDataFrame([(2000, "X", "a", None, "1", 1, 10), (2000, "X", "a", None, "1", 2, 11), (2000, "X", "b", "P", "1", 1, 5)], schema)
    new = spark.createDataFrame([(2000, "X", "a", None, "1", 0, 20)], schema)
    merged = win.merge_keep_latest(old, new, "house", sequence=["seq"])
    assert sorted((r["candidate"], r["candidatevotes"]) for r in merged.collect()) == [("a", 20), ("b", 5)]
    again = win.merge_keep_latest(old, new.limit(0), "house", sequence=["seq"])
    assert sorted((r["candidate"], r["candidatevotes"]) for r in again.collect()) == [("a", 11), ("b", 5)]


def test_running_votes_across_blocks(spark):
    rows = [("big", i, 1) for i in range(3000)] + [("small", 1, 5), ("small", 2, 6), (None, 1, 4)]
    df = spark.createDataFrame(rows, "race string, place int, candidatevotes int").repartition(7)
    sums = {(r["race"], r["place"]): r["cumsum"] for r in win.running_votes(df, ["race"], ["place"]).collect()}
    assert all(sums["big", i] == i + 1 for i in range(3000))
    assert sums["small", 2] == 11 and sums[None, 1] == 4


def test_interpolation_edges(spark):
    df = spark.createDataFrame(
        [
            (D(2020, 1, 1), None), (D(2020, 2, 1), 10.0), (D(2020, 2, 20), 20.0), (D(2020, 5, 1), 30.0), (D(2020, 7, 1), None),
        ],
        "date date, v double",
    )
    rows = {r["date"].month: r["v"] for r in win.interpolate_monthly(df, "date", ["v"]).collect()}
    assert rows == {1: None, 2: 15.0, 3: 20.0, 4: 25.0, 5: 30.0, 6: 30.0, 7: 30.0}


def test_align_ties_go_to_the_earlier_survey(spark):
    surveys = spark.createDataFrame(
        [(D(2020, 10, 30), 1.0), (D(2020, 11, 3), 2.0), (D(2030, 1, 1), 3.0), (D(2030, 1, 1), 9.0)], "date date, v double"
    )
    elections = spark.createDataFrame([(2020, "a"), (2020, "b"), (2029, "c"), (1990, "d")], "year int, who string")
    rows = {r["who"]: (r["survey_date"], r["v"]) for r in joins.align_nearest(surveys, elections).collect()}
    assert rows == {
        "a": (D(2020, 10, 30), 1.0), "b": (D(2020, 10, 30), 1.0), "c": (D(2030, 1, 1), 3.0), "d": (D(2020, 10, 30), 1.0)
    }


@pytest.fixture
def senate_rows(spark):
    """Regular class-1 elections in 1976 and 1982, class 2 in 1978, with two special elections."""
    rows = [
        (1976, "X", 1, False, "reg76"),
        (1978, "X", 1, True, "spec78"),   # class 1 is up again in 1982: sits for two sessions
        (1982, "X", 1, False, "reg82"),
        (1978, "X", 2, False, "reg78"),
        (1982, "X", 2, True, "spec82"),   # class 2 is up again in 1984: sits for one
        (1977, "Y", 2, True, "odd77"),    # odd year
        (1976, "Y", 1, False, "y76"),
    ]
    df = spark.createDataFrame(rows, "year int, state string, class int, special boolean, candidate string")
    return res.senate_class_columns(df)


def test_senate_terms(senate_rows):
    regular, special = res.split_special(senate_rows)
    sits = lambda df: sorted((r["year"], r["candidate"]) for r in df.collect())
    carried_special = joins.carry_special(special)
    assert sits(carried_special) == [(1977, "odd77"), (1978, "spec78"), (1980, "spec78"), (1982, "spec82")]
    kept = joins.drop_superseded(joins.carry_forward(regular), special)
    assert sits(kept) == sorted(
        [(1976, "reg76"), (1982, "reg82"), (1984, "reg82"), (1986, "reg82"), (1978, "reg78"), (1980, "reg78"),
         (1976, "y76"), (1978, "y76"), (1980, "y76")]
    )
    once = joins.carry_terms(senate_rows, special)
    assert sits(once) == sorted(sits(kept) + sits(carried_special))


def test_electors(spark):
    house = spark.createDataFrame(
        [(1976, "AA", "1"), (1976, "AA", "1"), (1976, "AA", "2"), (1978, "AA", "3")], "year int, state_po string, district string"
    )
    pres = spark.createDataFrame([(1976, "AA"), (1976, "DC"), (1976, "BB")], "year int, state_po string")
    rows = {r["state_po"]: r["electors"] for r in joins.attach_electors(pres, house).collect()}
    assert rows == {"AA": 4, "DC": 3, "BB": 2}


def test_distribution_histogram_and_stack(spark):
    seats = spark.createDataFrame(
        [(2000, "DEMOCRAT", 0, 4, 5), (2000, "DEMOCRAT", 1, 6, 5), (2000, "REPUBLICAN", 0, 6, 5), (2000, "REPUBLICAN", 1, 4, 5)],
        "eff_year int, party_simplified string, replicate int, seats long, count_win long",
    )
    spread = agg.seat_distribution(seats)
    assert {r["party_simplified"]: (r["mean_seats"], r["count_win"]) for r in spread.collect()} == {
        "DEMOCRAT": (5.0, 5), "REPUBLICAN": (5.0, 5), "OTHER": (0.0, 0), "LIBERTARIAN": (0.0, 0)
    }
    bands = {r["party_simplified"]: (r["lower"], r["upper"]) for r in agg.seat_stack(spread).collect()}
    assert bands == {"DEMOCRAT": (0.0, 5.0), "OTHER": (5.0, 5.0), "LIBERTARIAN": (5.0, 5.0), "REPUBLICAN": (95.0, 100.0)}
    bins = agg.seat_histogram(seats, bins=4)
    counts = {(r["party_simplified"], r["bin"]): r["n"] for r in bins.collect()}
    assert counts["DEMOCRAT", 0] == 1 and counts["DEMOCRAT", 3] == 1 and sum(counts.values()) == 4 and len(counts) == 8
    flat = agg.seat_histogram(seats.where("seats = 4"), bins=2).collect()
    assert {(r["bin"], r["edge_low"], r["edge_high"]) for r in flat} == {(0, 3.5, 4.0), (1, 4.0, 4.5)}
