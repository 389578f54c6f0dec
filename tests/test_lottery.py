from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pollwright.operators import lottery
from pollwright.operators import results as res
from pollwright.operators.standardize import import_election
from pollwright.plans import control

SCHEMA = "race string, candidate string, candidatevotes double, totalvotes double"


def uniform(seed, replicate, *keys):
    text = "|".join([str(seed), str(replicate // 4), *map(str, keys)])
    part = 8 * (replicate % 4)
    return int(hashlib.md5(text.encode()).hexdigest()[part : part + 8], 16) / 2**32


def expected(rows, race, n, seed, undervote="none"):
    """Winners of one race by a plain loop: walk the candidates until the die is covered."""
    inside = sorted((r for r in rows if r[0] == race), key=lambda r: (hashlib.md5(r[1].encode()).hexdigest()[:3], r[1]))
    total = max(r[3] for r in inside)
    out = {}
    for i in range(n):
        die, reached, won = uniform(seed, i, race) * total, 0.0, []
        for _, candidate, votes, _t in inside:
            reached += votes
            if votes > 0 and reached >= die:
                won = [candidate]
                break
        if not won and undervote == "all":
            won = [r[1] for r in inside]
        out[i] = won
    return out


@pytest.mark.parametrize("undervote", ["none", "all"])
def test_winners_match_a_plain_walk(spark, undervote):
    rows = [
        ("tied", "a", 5.0, 10.0), ("tied", "b", 5.0, 10.0),
        ("one", "a", 1.0, 1.0),
        ("under", "a", 2.0, 12.0), ("under", "b", 3.0, 12.0), ("under", "c", 1.0, 12.0),
        ("zero", "a", 0.0, 4.0), ("zero", "b", 4.0, 4.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    n = 40
    won = lottery.lottery_winners(df, ["race"], ["candidate"], n, 7, undervote).collect()
    assert len(won) == len(rows) * n
    for race in {r[0] for r in rows}:
        got = {i: sorted(r["candidate"] for r in won if r["race"] == race and r["replicate"] == i and r["won"]) for i in range(n)}
        assert got == {i: sorted(w) for i, w in expected(rows, race, n, 7, undervote).items()}
    assert all(r["won"] for r in won if r["race"] == "one")


def test_large_race_keeps_every_draw_unique(spark):
    """One race of 5,000 candidates spans many blocks; slices must tile the whole line."""
    big = spark.range(5000).select(
        F.lit("big").alias("race"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate"),
        (F.col("id") % 9).cast("double").alias("candidatevotes"),
        F.lit(None).cast("double").alias("totalvotes"),
    )
    total = big.agg(F.sum("candidatevotes")).first()[0]
    df = big.withColumn("totalvotes", F.lit(total))
    slices = lottery.vote_slices(df, ["race"], ["candidate"])
    tiles = sorted((r["below"], r["upto"]) for r in slices.where("votes > 0").collect())
    assert tiles[0][0] == 0 and tiles[-1][1] == total
    assert all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))
    seats = lottery.lottery_winners(df, ["race"], n=25).groupBy("replicate").agg(F.sum("won").alias("s"))
    assert [r["s"] for r in seats.collect()] == [1] * 25


def test_copies_of_a_ticket_are_added(spark):
    df = spark.createDataFrame([("r", "a", 1.0, 4.0)] * 3 + [("r", "b", 1.0, 4.0)], SCHEMA)
    slices = {r["candidate"]: r for r in lottery.vote_slices(df, ["race"], ["candidate"]).collect()}
    assert slices["a"]["votes"] == 3.0 and slices["a"]["count_win"] == 1 and slices["b"]["count_win"] == 0


def test_null_race_key_is_a_race(spark):
    df = spark.createDataFrame([(None, "a", 1.0, 2.0), (None, "b", 1.0, 2.0), ("", "c", 1.0, 1.0)], SCHEMA)
    rows = {r["candidate"]: r["race_votes"] for r in lottery.vote_slices(df, ["race"], ["candidate"]).collect()}
    assert rows == {"a": 2.0, "b": 2.0, "c": 1.0}


def house_rows(spark):
    rows = [
        (2000, "X", "XX", "1", "a", "DEMOCRAT", 10.0, 30.0),
        (2000, "X", "XX", "1", "b", "REPUBLICAN", 15.0, 30.0),
        (2000, "X", "XX", "1", "c", None, 5.0, 30.0),
        (2000, "X", "XX", "2", "d", "GREEN", 0.0, 1.0),
        (2000, "W", "DC", "1", "e", "DEMOCRAT", 9.0, 9.0),
        (2002, "X", "XX", "1", "f", "REPUBLICAN", 3.0, 3.0),
        (2002, "X", "XX", "1", "z", "DEMOCRAT", 0.0, 3.0),
    ]
    return spark.createDataFrame(
        rows,
        "year int, state string, state_po string, district string, candidate string, party string, "
        "candidatevotes double, totalvotes double",
    )


def test_house_seats_equal_races(spark):
    seats = control.house_control(house_rows(spark), 30)
    per = {(r["year"], r["replicate"]): r["s"] for r in seats.groupBy("year", "replicate").agg(F.sum("seats").alias("s")).collect()}
    assert per == {(2000, i): 2 for i in range(30)} | {(2002, i): 1 for i in range(30)}
    counts = {(r["year"], r["party_major"]): r["count_win"] for r in seats.where("replicate = 0").collect()}
    assert counts == {(2000, "DEMOCRAT"): 0, (2000, "REPUBLICAN"): 1, (2000, "OTHER"): 1, (2002, "REPUBLICAN"): 1}


def test_same_result_for_any_number_of_partitions(spark):
    results = []
    for parts in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = control.house_control(house_rows(spark).repartition(int(parts)), 20).collect()
        results.append(sorted(map(tuple, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_chances_follow_the_votes(spark):
    df = spark.createDataFrame([("r", "a", 70.0, 100.0), ("r", "b", 30.0, 100.0)], SCHEMA)
    wins = lottery.lottery_winners(df, ["race"], n=4000).where("candidate = 'a'").agg(F.avg("won")).first()[0]
    assert abs(wins - 0.7) < 0.03


def test_electors_all_cast(spark):
    pres = spark.createDataFrame(
        [(1976, "XX", "a", 6.0, 10.0), (1976, "XX", "b", 4.0, 10.0), (1976, "DC", "a", 1.0, 1.0)],
        "year int, state_po string, candidate string, candidatevotes double, totalvotes double",
    )
    house = spark.createDataFrame([(1976, "XX", "1"), (1976, "XX", "2")], "year int, state_po string, district string")
    drawn = control.elector_lottery(pres, house, 10)
    totals = [r["s"] for r in drawn.groupBy("replicate").agg(F.sum("electors").alias("s")).collect()]
    assert totals == [7] * 10


def test_unknown_totals_are_the_votes(spark):
    """A race without a total above 0, as new files have it, is drawn over the votes it has."""
    df = spark.createDataFrame(
        [("a", 60.0, 0.0), ("b", 40.0, None)], "candidate string, candidatevotes double, totalvotes double"
    ).withColumn("race", F.lit(1))
    wins = lottery.lottery_winners(df, ["race"], ["candidate"], n=200).groupBy("candidate").agg(F.sum("won").alias("w"))
    won = {r["candidate"]: r["w"] for r in wins.collect()}
    assert sum(won.values()) == 200 and won["a"] > won["b"] > 40


def test_imported_new_format_has_two_winners(spark):
    df = spark.createDataFrame(
        [(1, "oh", "OH", "District 7", 2022, "general", "Ann", "dem", "5"), (1, "oh", "OH", "District 7", 2022, "general", "Bob", "rep", "6")],
        "race_id int, state string, state_abbrev string, office_seat_name string, cycle int, stage string, "
        "candidate_name string, ballot_party string, votes string",
    )
    won = control.house_winners(import_election(df, "house"), 200).where("won = 1").select("candidate").distinct()
    assert won.count() == 2


def test_contested_races_as_if_cleaned_before(spark):
    rows = [
        ("lone", "a", 0.0, 9.0), ("none", "a", None, 0.0), ("pair", "a", 0.0, 7.0), ("pair", "b", 5.0, 6.0),
        ("zero", "a", 0.0, 3.0), ("zero", "b", 0.0, 3.0), ("three", "a", 1.0, None), ("three", "b", 2.0, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cleaned = res.drop_zero_votes(res.fix_unopposed(df, ["race"])).drop("unopposed")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    got = lottery.vote_slices(df, ["race"], ["candidate"], contested=True)
    want = lottery.vote_slices(cleaned, ["race"], ["candidate"])
    assert got.columns == want.columns and key(got) == key(want)


def hostile(spark):
    """Races of every odd kind: totals short, above or unknown, no votes, one ticket, null keys."""
    rows = [(f"r{i % 7}", f"c{i}", float(i * i % 23), 40.0 + i % 7) for i in range(60)]
    rows += [("short", "a", 9.0, 4.0), ("short", "b", 9.0, 4.0), ("over", "a", 1.0, 50.0), ("over", "b", 2.0, 50.0)]
    rows += [("unknown", "a", 3.0, None), ("unknown", "b", 5.0, None), ("none", "a", 0.0, 0.0), ("none", "b", None, None)]
    rows += [("lone", "a", 0.0, 9.0), (None, "a", 2.0, 5.0), (None, "b", 3.0, 5.0), ("", "a", 1.0, 1.0)]
    rows += [("skewed", "big", 1e9, 1e9 + 500)] + [("skewed", f"c{i}", 1.0, 1e9 + 500) for i in range(500)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("contested", [False, True])
def test_located_winners_are_the_drawn_ones(spark, contested):
    slices = lottery.vote_slices(hostile(spark), ["race"], ["candidate"], contested=contested, sized=True).cache()
    located = lottery.locate_winners(slices, ["race"], 60, 5).select("race", "candidate", "replicate").collect()
    drawn = lottery.draw_winners(slices, ["race"], 60, 5).where("won = 1").select("race", "candidate", "replicate")
    assert sorted(located, key=str) == sorted(drawn.collect(), key=str) and len(located) == len(set(located)) > 500
    electors = slices.withColumn("electors", F.lit(3))
    located = lottery.locate_winners(electors, ["race"], 20, 5, "electors").groupBy("race", "candidate", "replicate").count()
    drawn = lottery.draw_electors(electors, ["race"], "electors", 20, 5).groupBy("race", "candidate", "replicate")
    want = drawn.agg(F.sum("won").alias("count")).where("count > 0")
    assert sorted(located.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_votes_at_all_elect_nobody(spark):
    slices = lottery.vote_slices(spark.createDataFrame([], SCHEMA), ["race"], ["candidate"], sized=True)
    assert lottery.locate_winners(slices, ["race"], 5, 1).collect() == []


def test_hot_race_is_drawn_once_per_replicate(spark):
    """50,000 candidates in one race: a draw meets the few slices of its cell, not all of them."""
    big = spark.range(50_000).select(
        F.lit("hot").alias("race"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate"),
        F.when(F.col("id") == 7, 1e7).otherwise((F.col("id") % 9).cast("double")).alias("candidatevotes"),
        F.lit(0.0).alias("totalvotes"),
    )
    slices = lottery.vote_slices(big, ["race"], ["candidate"], sized=True).cache()
    won = lottery.locate_winners(slices, ["race"], 200, 3)
    rows = won.select("replicate", "candidate").collect()
    assert sorted(r["replicate"] for r in rows) == list(range(200)) and any(r["candidate"] != "c7" for r in rows)
    cells = slices.where("votes > 0").select(lottery._cell("below").alias("a"), lottery._cell("upto").alias("b"))
    listed = cells.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0]
    assert listed <= 2 * 50_000 + 1


def test_control_is_the_same_by_listing_everyone(spark):
    """With every vote in the totals the two undervote rules agree, and so do the two ways."""
    df = house_rows(spark)
    got = control.house_control(df, 40, 9)
    want = control.house_control(df, 40, 9, undervote="all")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
