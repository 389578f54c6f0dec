from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pollwright.operators import ballots as bal


def table(spark, scores, race=1):
    return spark.createDataFrame(
        [(i, race, list(map(float, s))) for i, s in enumerate(scores)], "voter_id long, race int, scores array<double>"
    )


def test_worked_example(spark):
    df = table(spark, [[0.2, 0.4, 0.3, 0.1]])
    assert bal.plurality_ballot(df).first()["plurality"] == [0, 1, 0, 0]
    assert bal.ranked_ballot(df).first()["ranks"] == [3, 1, 2, 4]


def test_edge_ballots(spark):
    df = table(spark, [[0, 0, 0], [1, 1, 1], [-1, 2, 2], [5, 0, 0]])
    rows = bal.approval_ballot(bal.ranked_ballot(bal.normalize_scores(df))).orderBy("voter_id").collect()
    assert [r["scores"] for r in rows] == [[0, 0, 0], [1 / 3] * 3, [0, 0.5, 0.5], [1, 0, 0]]
    assert [r["ranks"] for r in rows] == [[1, 2, 3], [1, 2, 3], [3, 1, 2], [1, 2, 3]]
    assert [r["approvals"] for r in rows] == [[0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    single = bal.approval_ballot(table(spark, [[3]])).first()
    assert single["approvals"] == [0]


def runoff(orders, options):
    """The rounds of one race by a plain loop."""
    standing, out = list(range(options)), []
    while len(standing) > 1:
        first = [0] * options
        for o in orders:
            first[next(c for c in o if c in standing)] += 1
        best = max(standing, key=lambda c: (first[c], -c))
        if first[best] * 2 > len(orders):
            return best, out
        worst = min(standing, key=lambda c: (first[c], c))
        standing.remove(worst)
        out.append(worst)
    return standing[0], out


def test_all_methods_against_loops(spark):
    rng = random.Random(3)
    m, data = 4, {}
    for race in range(6):
        data[race] = [[rng.randint(0, 4) for _ in range(m)] for _ in range(rng.randint(3, 25))]
    data[6] = [[3, 2, 1, 0], [1, 3, 2, 0], [2, 1, 3, 0]]  # a cycle of three
    df = spark.createDataFrame(
        [(f"{r}-{i}", r, list(map(float, s))) for r, b in data.items() for i, s in enumerate(b)],
        "voter_id string, race int, scores array<double>",
    )
    get = lambda d, *k: {tuple(r[x] for x in k): r for r in d.collect()}
    plurality = get(bal.plurality_count(df, ["race"]), "race", "option")
    approval = get(bal.approval_count(df, ["race"]), "race", "option")
    borda = get(bal.borda_count(df, ["race"]), "race", "option")
    places = get(bal.rank_distribution(df, ["race"]), "race", "option", "rank")
    condorcet = get(bal.condorcet(df, ["race"]), "race", "option")
    percent = get(bal.pairwise_percent(df, ["race"]), "race", "option", "opponent")
    irv = get(bal.instant_runoff(df, ["race"]), "race")
    for race, scores in data.items():
        orders = [sorted(range(m), key=lambda c: (-s[c], c)) for s in scores]
        for c in range(m):
            assert plurality[race, c]["total"] == sum(o[0] == c for o in orders)
            assert borda[race, c]["total"] == sum(m - o.index(c) for o in orders)
            for rank in range(1, m + 1):
                assert places[race, c, rank]["n"] == sum(o[rank - 1] == c for o in orders)
            approved = 0
            for s in scores:
                mean = sum(s) / m
                approved += s[c] > mean + (sum((x - mean) ** 2 for x in s) / (m - 1)) ** 0.5
            assert approval[race, c]["total"] == approved
            beaten = 0
            for d in range(m):
                if d != c:
                    over, under = sum(s[c] > s[d] for s in scores), sum(s[d] > s[c] for s in scores)
                    beaten += over > under
                    assert percent[race, c, d]["percent"] == pytest.approx(100 * over / len(scores))
            assert condorcet[race, c]["total"] == beaten and condorcet[race, c]["is_winner"] == (beaten == m - 1)
        assert sum(borda[race, c]["total"] for c in range(m)) == len(scores) * m * (m + 1) // 2
        for counted in (plurality, approval, borda):
            best = max(range(m), key=lambda c: (counted[race, c]["total"], -c))
            assert [c for c in range(m) if counted[race, c]["is_winner"]] == [best]
        winner, out = runoff(orders, m)
        got = irv[(race,)]
        assert (got["winner"], got["elimination_order"], got["rounds"]) == (winner, out, len(out))
    assert not any(condorcet[6, c]["is_winner"] for c in range(m))


def test_without_race_and_single_option(spark):
    df = table(spark, list(itertools.permutations([1, 2, 3])))
    (row,) = bal.instant_runoff(df).collect()
    assert row["rounds"] == len(row["elimination_order"]) == 2 and row["winner"] == 2
    assert bal.method_results(df).count() == 15
    (one,) = bal.instant_runoff(table(spark, [[1.0], [2.0]]), ["race"]).collect()
    assert (one["winner"], one["rounds"]) == (0, 0)


def test_runoff_of_short_and_empty_ballots(spark):
    """Options beyond a short ballot are never its choice; it runs out and still counts in the total."""
    df = table(spark, [[1, 2], [1, 2], [5, 4, 9], [5, 4, 9], [5, 4, 9], []])
    (row,) = bal.instant_runoff(df, ["race"]).collect()
    assert (row["winner"], row["elimination_order"]) == (2, [])
    assert bal.instant_runoff(table(spark, [[]]), ["race"]).count() == 0


def test_null_and_nan_rank_last(spark):
    nan = float("nan")
    rows = [[None, 0.3, 0.2], [nan, 0.5, 0.1], [0.1, None, nan], [None, nan, None]]
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(rows)], "voter_id long, race int, scores array<double>")
    ranking = {r["voter_id"]: r["ranking"] for r in bal.ranked_ballot(df).collect()}
    assert ranking == {0: [1, 2, 0], 1: [1, 2, 0], 2: [0, 1, 2], 3: [0, 1, 2]}
    for count in (bal.plurality_count, bal.borda_count):
        winners = {r["race"]: r["option"] for r in count(df, ["race"]).where("is_winner").collect()}
        assert winners == {0: 1, 1: 1, 2: 0, 3: 0}
    irv = {r["race"]: r["winner"] for r in bal.instant_runoff(df, ["race"]).collect()}
    assert irv == {0: 1, 1: 1, 2: 0, 3: 0}
    duels = {(r["race"], r["a"], r["b"]): (r["a_over_b"], r["b_over_a"]) for r in bal.pairwise(df, ["race"]).collect()}
    assert duels[0, 0, 1] == (0, 1) and duels[1, 0, 2] == (0, 1) and duels[2, 1, 2] == (0, 0) and duels[3, 0, 1] == (0, 0)


def test_only_option_wins_every_pair(spark):
    (row,) = bal.condorcet(table(spark, [[1.0], [2.0]]), ["race"]).collect()
    assert (row["option"], row["total"], row["is_winner"]) == (0, 0, True)


def test_many_options(spark):
    rng = random.Random(8)
    m = 64
    scores = [[rng.random() for _ in range(m)] for _ in range(40)]
    df = table(spark, scores)
    orders = [sorted(range(m), key=lambda c: (-s[c], c)) for s in scores]
    winner, out = runoff(orders, m)
    got = bal.instant_runoff(df, ["race"]).first()
    assert (got["winner"], got["elimination_order"]) == (winner, out)
    beaten = {r["option"]: r["total"] for r in bal.condorcet(df, ["race"]).collect()}
    for c in (0, 31, 63):
        assert beaten[c] == sum(2 * sum(s[c] > s[d] for s in scores) > len(scores) for d in range(m) if d != c)


def test_passes_of_pairs(spark, monkeypatch):
    """More different rankings than pairs of options: passes see the first two options, and settle
    at least two eliminations each, as a plain recount does."""
    rng = random.Random(3)
    passes = []
    plain = bal._settle_rounds
    monkeypatch.setattr(bal, "_settle_rounds", lambda *args: passes.append(1) or plain(*args))
    races = {}
    for r, (m, n, close) in enumerate([(6, 300, 1.0), (8, 400, 0.3), (7, 250, 3.0), (5, 60, 0.0)]):
        # Some options are liked better than others; the last race is full of ties.
        races[r] = [[rng.random() + close * o / m if close else float(rng.randint(0, 2)) for o in range(m)] for _ in range(n)]
    rows = [(i, r, s) for r, scores in races.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "voter_id bigint, race bigint, scores array<double>")
    got = {r["race"]: (r["winner"], r["elimination_order"]) for r in bal.instant_runoff(df, ["race"]).collect()}
    for r, scores in races.items():
        orders = [sorted(range(len(s)), key=lambda o: (-s[o], o)) for s in scores]
        winner, out = runoff(orders, len(scores[0]))
        assert got[r] == (winner, out)
    assert 1 < len(passes) <= 4


def test_runoff_leaves_no_files(spark):
    """Checkpoints go when nobody refers to them."""
    import gc
    import time
    from pathlib import Path

    from pollwright.session import scratch_dir

    # Spark's folder for this session lies below the shared one.
    shared = Path(scratch_dir(spark).removeprefix("file:"))
    files = lambda: {str(p) for p in shared.glob("*/rdd-*")}
    before = files()
    rows = bal.instant_runoff(table(spark, [[1, 2, 3], [3, 2, 1], [2, 3, 1]]), ["race"]).collect()
    assert len(rows) == 1 and files() - before
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not files() - before:
            break
        time.sleep(0.5)
    assert not files() - before


def test_sorting(spark):
    df = table(spark, [[2, 1], [1, 3], [1, 2], [3, 0]])
    assert [r["voter_id"] for r in bal.sort_lexicographic(df).collect()] == [2, 1, 0, 3]
    assert [r["voter_id"] for r in bal.sort_by_top_choice(df).collect()] == [0, 3, 1, 2]
    values = bal.ballot_matrix(df).first()["values"]
    assert values == [2.0, 1.0, 1.0, 0.0, 0.5, 1.0, 0.0, 0.0]


def test_distance_scores(spark):
    df = spark.createDataFrame([(1, 0)], "voter_id int, choice int")
    scores = bal.distance_scores(df, bal.line_positions(3)).first()["scores"]
    raw = [1.0, 1 / 2, 1 / 5]
    assert scores == pytest.approx([r / sum(raw) for r in raw])


@pytest.mark.parametrize("n", [1, 64, 65, 600])
def test_nearest_option_listed_and_in_a_table(spark, n):
    """One row out per row in, at every number of options: equal and null ids, odd widths, null."""
    options = [(i, [float(i % 8), float(i % 3)]) for i in range(n)]
    rows = [(i % 40 if i % 9 else None, [float(i % 17), float(i % 5)]) for i in range(120)]
    rows += [(7, [1.0, 2.0, 3.0]), (7, None), (None, [1.0])]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    wide = spark.createDataFrame(options, "option int, center array<double>")
    want = []
    for i, x in rows:
        if x is None or len(x) != 2:
            want.append((i, None, None))
        else:
            d2, o = min(((x[0] - c[0]) ** 2 + (x[1] - c[1]) ** 2, o) for o, c in options)
            want.append((i, o, d2**0.5))
    order = lambda r: tuple((v is not None, v) for v in r)
    for got in (bal.nearest_option(points, options), bal.nearest_option_in_table(points, wide)):
        assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert bal.nearest_option(points, []).where("option is not null").count() == 0
    none = bal.nearest_option_in_table(points, wide.limit(0))
    assert none.count() == len(rows) and none.where("option is not null").count() == 0


@pytest.mark.parametrize("count", [bal.instant_runoff, bal.method_results])
def test_runoff_sends_states_alone_through_the_driver(spark, monkeypatch, count):
    """Only the right side of a left join can be broadcast: one short row a race."""
    plain, joined = bal.null_safe_join, []

    def spied(left, right, keys, how="inner"):
        joined.append((how, set(right.columns) & {"ranking", "heads"}, right.count()))
        return plain(left, right, keys, how)

    monkeypatch.setattr(bal, "null_safe_join", spied)
    scores = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double") for i in range(5)])
    df = spark.range(300).select(F.col("id").alias("voter_id"), F.nullif(F.col("id") % 3, F.lit(1)).alias("race"), scores.alias("scores"))
    assert count(df, ["race"]).select("race").distinct().count() == 3
    assert joined and set(map(str, joined)) == {str(("left", set(), 3))}
