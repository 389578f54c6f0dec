"""Ballot counts.

A ballot is a row with ``voter_id`` and ``scores``, an array with one score per option. Every
function takes ``race``, the columns that tell elections apart (none by default). Ties always
go to the lower option index; null and NaN rank below every number. Counts are plain group-bys:
ballots are added up map-side, so one huge race costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.columns import (
    above_spread,
    let,
    normalized,
    one_hot_array,
    preference_order,
    preferred,
    ranks,
    squared_distance,
    top_position,
)
from pollwright.functions.scale import null_safe_join, pair_with_blocks, repeat_rows
from pollwright.session import Scratch, cut


def plurality_ballot(df: DataFrame) -> DataFrame:
    """``choice``: the top option, and ``plurality``: its one-hot array."""
    choice = top_position("scores")
    return df.withColumns({"choice": choice, "plurality": one_hot_array(F.col("scores"), choice)})


def ranked_ballot(df: DataFrame) -> DataFrame:
    """``ranking``: options from best to worst, and ``ranks``: the rank of each option."""
    ranking = preference_order("scores")
    return df.withColumns({"ranking": ranking, "ranks": ranks(ranking)})


def approval_ballot(df: DataFrame) -> DataFrame:
    """``approvals``: 1 where the score exceeds the ballot's mean plus sample deviation."""
    return df.withColumn("approvals", above_spread("scores"))


def normalize_scores(df: DataFrame) -> DataFrame:
    """Scores clamped at 0 and divided by their sum; an all-zero ballot stays zero."""
    return df.withColumn("scores", normalized("scores"))


def _tally(per_option: DataFrame, race: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Add the winner flag. The window holds one row per option of a race, never ballots."""
    in_race = Window.partitionBy(*race).orderBy(F.desc("total"), F.asc("option"))
    return (
        per_option.withColumns(extra or {})
        .withColumn("is_winner", F.row_number().over(in_race) == 1)
        .drop("_ballots")
    )


def _percent() -> dict[str, Column]:
    return {"percent": F.col("total") * F.lit(100.0) / F.col("_ballots")}


def _sum_per_option(df: DataFrame, race: Sequence[str], values: Column) -> DataFrame:
    """Sum of an array over all ballots, one row per option; ``_ballots`` counts the ballots."""
    return (
        df.select(*race, F.posexplode(values).alias("option", "_value"))
        .groupBy(*race, "option")
        .agg(F.sum("_value").cast("bigint").alias("total"), F.count(F.lit(1)).alias("_ballots"))
    )


def plurality_count(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, total, percent, is_winner): first choices, zeros included."""
    return _tally(_sum_per_option(plurality_ballot(df), race, F.col("plurality")), race, _percent())


def approval_count(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, total, percent, is_winner): approvals."""
    return _tally(_sum_per_option(approval_ballot(df), race, F.col("approvals")), race, _percent())


def borda_count(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, total, average, is_winner): M points for the best, 1 for the worst."""
    # The place in the ranking is the rank, so the array of ranks is not needed.
    places = df.select(
        *race, F.posexplode(preference_order("scores")).alias("_place", "option"), F.size("scores").alias("_m")
    )
    summed = places.groupBy(*race, "option").agg(
        F.sum(F.col("_m") - F.col("_place")).cast("bigint").alias("total"), F.count(F.lit(1)).alias("_ballots")
    )
    return _tally(summed, race, {"average": F.col("total") / F.col("_ballots")})


def rank_distribution(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, rank, n): ballots that put the option at the rank, zeros included."""
    order = F.posexplode(preference_order("scores")).alias("_place", "option")
    places = df.select(*race, order).withColumn("rank", F.col("_place") + 1)
    counted = places.groupBy(*race, "option", "rank").agg(F.count(F.lit(1)).alias("n"))
    width = counted.groupBy(*race).agg(F.max("rank").alias("_m"))
    zeros = (
        width.withColumn("option", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("_m"))))
        .select(*race, "option", "rank", F.lit(0).cast("bigint").alias("n"))
    )
    return counted.unionByName(zeros).groupBy(*race, "option", "rank").agg(F.sum("n").alias("n"))


def pairwise(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, a, b, a_over_b, b_over_a, ballots) for options a < b.

    Comparisons are made inside one ballot and added up in the same stage: what is shuffled is
    one row per race, option pair and task. A comparison's row carries its two scores only.
    """
    upto = F.size("scores") - 1
    left = df.where(F.size("scores") > 1).select(
        *race, "scores", F.explode(F.sequence(F.lit(0), upto - 1)).alias("a")
    )
    rest = F.slice("scores", F.col("a") + 2, F.size("scores"))
    both = left.select(*race, "a", F.get("scores", F.col("a")).alias("x"), F.posexplode(rest).alias("at", "y"))
    both = both.withColumn("b", F.col("a") + 1 + F.col("at"))
    a, b = F.col("x"), F.col("y")
    return both.groupBy(*race, "a", "b").agg(
        F.count_if(preferred(a, b)).alias("a_over_b"),
        F.count_if(preferred(b, a)).alias("b_over_a"),
        F.count(F.lit(1)).alias("ballots"),
    )


def _both_ways(pairs: DataFrame, race: Sequence[str]) -> DataFrame:
    """Each pair as two rows: (option, opponent, wins, losses, ballots)."""
    rows = F.array(
        F.struct(
            F.col("a").alias("option"), F.col("b").alias("opponent"),
            F.col("a_over_b").alias("wins"), F.col("b_over_a").alias("losses"),
        ),
        F.struct(
            F.col("b").alias("option"), F.col("a").alias("opponent"),
            F.col("b_over_a").alias("wins"), F.col("a_over_b").alias("losses"),
        ),
    )
    return pairs.select(*race, "ballots", F.explode(rows).alias("p")).select(*race, "p.*", "ballots")


def condorcet(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, total, is_winner): pairs won; the winner wins all of them, or nobody does.
    The only option of a race wins it."""
    duels = _both_ways(pairwise(df, race), race).select(*race, "option", "wins", "losses")
    options = df.groupBy(*race).agg(F.max(F.size("scores")).alias("_m")).where(F.col("_m") > 0)
    listed = options.select(*race, F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("option"))
    won = F.count_if(F.col("wins") > F.col("losses"))
    return (
        duels.unionByName(listed, allowMissingColumns=True)
        .groupBy(*race, "option")
        .agg(won.alias("total"), (won == F.count("wins")).alias("is_winner"))
    )


def pairwise_percent(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, option, opponent, percent): ballots that prefer the option to the opponent."""
    duels = _both_ways(pairwise(df, race), race)
    return duels.select(
        *race, "option", "opponent", (F.col("wins") * F.lit(100.0) / F.col("ballots")).alias("percent")
    )


def instant_runoff(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, winner, elimination_order, rounds), all races at once.

    Ballots are reduced to distinct rankings with their counts once. A pass takes the first two
    remaining options of the rankings, of which there are no more than pairs of options, and settles
    rounds from that alone: when an option goes out, its votes move to the second options. It
    stops when ballots whose both options are out could change the next round, which is after two
    eliminations at the earliest. Then the options that are out leave the rankings and equal
    remainders are added up. A race with no more different rankings than pairs takes them whole,
    and that pass is its last.
    """
    return _settle(df, list(race)).select(
        *race, "winner", F.col("out").alias("elimination_order"), F.size("out").alias("rounds")
    )


def _settle(df: DataFrame, race: list[str]) -> DataFrame:
    """(race, ballots, options, out, winner) of every race."""
    ballots = df if race else df.withColumn("_all", F.lit(0))
    rankings = ballots.where(F.size("scores") > 0).select(*(race or ["_all"]), preference_order("scores").alias("ranking"))
    return _settle_rankings(rankings, race or ["_all"])


def _settle_rankings(rankings: DataFrame, keys: list[str]) -> DataFrame:
    """``_settle`` of plain rankings, one row a ballot. Every distinct ranking carries the state of
    its race, so a pass writes one table, which shrinks from pass to pass."""
    scratch = Scratch(rankings.sparkSession, "runoff")
    rankings = scratch.table(rankings.groupBy(*keys, "ranking").agg(F.count(F.lit(1)).alias("n")))
    state = rankings.groupBy(*keys).agg(F.sum("n").alias("ballots"), F.max(F.size("ranking")).alias("options"))
    state = state.withColumn("out", F.array().cast("array<int>")).withColumn("winner", _last_left(F.col("out")))
    # Every ranking has a state; as a left join it can send the states alone through the driver.
    rows = scratch.table(null_safe_join(rankings, state, keys, "left"))
    columns = ["ballots", "options", "out", "winner"]
    finished = []
    while True:
        scratch.drop(last=1)
        # A race has its state on all its rows.
        of_race = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns])
        finished.append(cut(of_race.where(F.col("winner").isNotNull())))
        rows = rows.where(F.col("winner").isNull())
        if rows.isEmpty():
            scratch.drop()
            return reduce(DataFrame.unionByName, finished)
        state = _settle_rounds(rows, keys)
        left = F.array_except("ranking", "out").alias("ranking")
        rows = null_safe_join(rows.select(*keys, "ranking", "n"), state, keys, "left").select(*keys, left, "n", *columns)
        rows = scratch.table(rows.groupBy(*keys, "ranking", *columns).agg(F.sum("n").alias("n")))


def _last_left(out: Column) -> Column:
    """The only option left, null while there are several."""
    remaining = F.array_except(F.sequence(F.lit(0), F.col("options") - 1), out)
    return F.when(F.size(remaining) == 1, F.get(remaining, F.lit(0)))


def _prefixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per race: its state, and in ``heads`` the starts of its rankings with their ballots.

    A start is a pair of options, so a race has at most as many as there are pairs. Where that
    bound admits all its rankings, they are taken whole (``whole``: nothing follows the start)."""
    columns = ["ballots", "options", "out", "winner"]
    states = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("held"))
    short = states.select(*keys, (F.col("held") > F.col("options") * F.col("options")).alias("short"))
    start = F.when(F.col("short"), F.slice("ranking", 1, 2)).otherwise(F.col("ranking"))
    heads = null_safe_join(rows.select(*keys, "ranking", "n"), short, keys, "left").select(
        *keys, start.alias("p"), (F.size("ranking") == F.size(start)).alias("whole"), "n"
    )
    heads = heads.groupBy(*keys, "p", "whole").agg(F.sum("n").alias("n"))
    heads = heads.groupBy(*keys).agg(F.collect_list(F.struct("p", "n", "whole")).alias("heads"))
    return null_safe_join(heads, states.drop("held"), keys, "left")


def _settle_rounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state of every race after all rounds that the starts of its rankings settle.

    ``c`` are the ballots known to be with each option, -1 for those that are out, and ``u`` the
    ballots whose start is used up: they can be with any option left, or with none.
    """
    zero = F.lit(0).cast("bigint")
    options = F.sequence(F.lit(0), F.col("options") - 1)
    first = lambda x: F.get(x["p"], F.lit(0))

    def add(c: Column, x: Column) -> Column:
        return let(first(x), lambda o: F.transform(c, lambda v, i: F.when(i == o, v + x["n"]).otherwise(v)))

    def of_standing(a: Column) -> Column:
        """The standing options with their known ballots, the lowest and the top of them."""
        each = F.filter(F.transform(a["c"], lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["v"] >= 0)
        top = lambda s: F.array_min(F.transform(s, lambda x: F.struct((-x["v"]).alias("v"), x["i"].alias("i"))))
        return let(each, lambda s: F.struct(s.alias("s"), F.array_min(s).alias("low"), top(s).alias("top")))

    def without(heads: Column, low: Column) -> Column:
        return F.transform(
            heads, lambda x: F.struct(F.array_remove(x["p"], low).alias("p"), x["n"].alias("n"), x["whole"].alias("whole"))
        )

    def eliminate(a: Column, low: Column, moved: Column) -> Column:
        bare = F.transform(a["c"], lambda v, i: F.when(i == low, F.lit(-1).cast("bigint")).otherwise(v))
        lost = F.aggregate(moved, zero, lambda s, x: s + F.when(~x["whole"] & (F.size(x["p"]) == 0), x["n"]).otherwise(zero))
        gone = F.array_append(a["out"], low)
        return F.struct(
            gone.alias("out"),
            F.aggregate(moved, bare, add).alias("c"),
            (a["u"] + lost).alias("u"),
            without(a["heads"], low).alias("heads"),
            _last_left(gone).alias("winner"),
            (F.size(gone) < F.col("options") - 1).alias("on"),
        )

    def stop(a: Column, winner: Column) -> Column:
        kept = [a[c].alias(c) for c in ("out", "c", "u", "heads")]
        return F.struct(*kept, winner.alias("winner"), F.lit(False).alias("on"))

    def round_of(a: Column, x: Column) -> Column:
        low, most = x["low"], -x["top"]["v"]
        # Whether an option could turn out to be below the lowest, with all of ``u`` for that one.
        limit = F.struct((low["v"] + a["u"]).alias("v"), low["i"].alias("i"))
        rivals = let(limit, lambda m: F.filter(x["s"], lambda s: (s < m) & (s["i"] != low["i"])))
        moved = without(F.filter(a["heads"], lambda h: first(h) == low["i"]), low["i"])
        return (
            F.when(most * 2 > F.col("ballots"), stop(a, x["top"]["i"]))
            .when(((most + a["u"]) * 2 > F.col("ballots")) | (F.size(rivals) > 0), stop(a, a["winner"]))
            .otherwise(let(moved, lambda m: eliminate(a, low["i"], m)))
        )

    def start(known: Column) -> Column:
        return F.struct(
            F.col("out").alias("out"),
            known.alias("c"),
            zero.alias("u"),
            F.col("heads").alias("heads"),
            F.col("winner").alias("winner"),
            F.col("winner").isNull().alias("on"),
        )

    bare = F.transform(options, lambda i: F.when(F.array_contains("out", i), F.lit(-1).cast("bigint")).otherwise(zero))
    step = lambda a, _: F.when(a["on"], let(of_standing(a), lambda x: round_of(a, x))).otherwise(a)
    settled = let(F.aggregate("heads", bare, add), lambda known: F.aggregate(options, start(known), step))
    result = let(settled, lambda a: F.struct(a["out"].alias("out"), a["winner"].alias("winner")))
    counted = _prefixes(rows, keys).select(*keys, "ballots", "options", result.alias("settled"))
    return counted.select(*keys, "ballots", "options", "settled.out", "settled.winner")


def method_results(df: DataFrame, race: Sequence[str] = ()) -> DataFrame:
    """(race, method, option, total, is_winner) of all five methods.

    For the instant runoff ``total`` is the round in which an option went out, null for those
    still standing at the end.
    """
    listed = _settle(df, list(race)).withColumn(
        "option", F.explode(F.sequence(F.lit(0), F.col("options") - 1))
    )
    rows = listed.select(
        *race,
        F.lit("instant_runoff").alias("method"),
        "option",
        F.nullif(F.array_position("out", F.col("option")), F.lit(0)).cast("bigint").alias("total"),
        (F.col("option") == F.col("winner")).alias("is_winner"),
    )
    tallies = {
        "plurality": plurality_count,
        "approval": approval_count,
        "borda": borda_count,
        "condorcet": condorcet,
    }
    for method, count in tallies.items():
        rows = rows.unionByName(
            count(df, race).select(*race, F.lit(method).alias("method"), "option", "total", "is_winner")
        )
    return rows


def sort_lexicographic(df: DataFrame, key: str = "voter_id") -> DataFrame:
    """Ballots in element-by-element order of their scores, equal ones by ``key``."""
    return df.orderBy("scores", key)


def sort_by_top_choice(df: DataFrame, key: str = "voter_id") -> DataFrame:
    """Ballots by their top option, then by ``key``."""
    return df.withColumn("choice", top_position("scores")).orderBy("choice", key)


def ballot_matrix(df: DataFrame, key: str = "voter_id") -> DataFrame:
    """Scores, one-hot, rank / M and approvals side by side in ``values``, by top choice."""
    full = approval_ballot(ranked_ballot(plurality_ballot(df)))
    values = F.concat(
        "scores",
        F.transform("plurality", lambda x: x.cast("double")),
        F.transform("ranks", lambda r: r / F.size("ranks")),
        F.transform("approvals", lambda x: x.cast("double")),
    )
    kept = [c for c in df.columns if c != "scores"]
    return full.select(*kept, "choice", values.alias("values")).orderBy("choice", key)


def line_positions(n_options: int, n_dimensions: int = 3) -> list[list[float]]:
    """Options one apart on the first axis."""
    return [[float(i)] + [0.0] * (n_dimensions - 1) for i in range(n_options)]


def _literal_vectors(vectors: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in vec]) for vec in vectors])


def distance_scores(df: DataFrame, positions: Sequence[Sequence[float]], choice: str = "choice") -> DataFrame:
    """``scores`` of a voter whose main option is ``choice``: ``1 / (1 + d^2)``, normalised."""
    options = _literal_vectors(positions)

    def by_distance(own: Column) -> Column:
        return F.transform(options, lambda p: F.lit(1.0) / (F.lit(1.0) + squared_distance(p, own)))

    return df.withColumn("scores", normalized(let(F.get(options, F.col(choice)), by_distance)))


def _closest(options: Column, x: str) -> Column:
    """Smallest (d2, option) over an array of (option, center) of the point's width."""
    fitting = F.filter(options, lambda o: F.size(o["center"]) == F.size(x))
    return F.array_min(
        F.transform(
            fitting,
            lambda o: F.struct(squared_distance(F.col(x), o["center"]).alias("d2"), o["option"].alias("option")),
        )
    )


def nearest_option(
    points: DataFrame, options: Sequence[tuple[int, Sequence[float]]], key: str = "id", x: str = "x"
) -> DataFrame:
    """(key, option, distance): the listed option closest to each point, the lower one on ties.

    One row out for each row in; a point of another width than all options, or null, has null.
    Each row is settled on its own, so nothing moves.
    """
    if not options:
        return points.select(key, F.lit(None).cast("int").alias("option"), F.lit(None).cast("double").alias("distance"))
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("option"), F.array(*[F.lit(float(v)) for v in center]).alias("center"))
            for name, center in options
        ]
    )
    best = points.select(key, _closest(listed, x).alias("_best"))
    return best.select(key, "_best.option", F.sqrt("_best.d2").alias("distance"))


def nearest_option_in_table(
    points: DataFrame, options: DataFrame, key: str = "id", x: str = "x", option: str = "option", center: str = "center"
) -> DataFrame:
    """``nearest_option`` for a table of options that may be long, with the same contract.

    Equal (key, point) rows are counted and settled once. Each is met by every block of options,
    the best of all blocks is kept, and the row is repeated as often as it came.
    """
    counted = points.select(key, x).groupBy(key, x).agg(F.count(F.lit(1)).alias("_n"))
    slim = options.select(F.col(option).alias("option"), F.col(center).alias("center"))
    blocks = pair_with_blocks(counted, slim, key="option", spread=x)
    best = blocks.select(key, x, "_n", _closest(F.col("_options"), x).alias("_best"))
    best = best.groupBy(key, x, "_n").agg(F.min("_best").alias("_best"))
    return repeat_rows(best, "_n", key).select(key, "_best.option", F.sqrt("_best.d2").alias("distance"))
