"""Queries on ballots. Arrays are shown one element per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwright.catalog.registry import placed, query, rounded
from pollwright.operators import ballots as bal

RACE = ["race"]


def _elements(df, array: str, value: str, *keys: str):
    return df.select(*(keys or ("voter_id",)), F.posexplode(array).alias("option", value))


@query(
    "plurality_ballot",
    ["ballot_ranks"],
    "select voter_id, option, case when rank = 1 then 1 else 0 end as vote from ballot_ranks",
)
def _(t):
    return _elements(bal.plurality_ballot(t.ballots), "plurality", "vote")


@query("ranked_ballot", ["ballot_ranks"], "select voter_id, option, rank from ballot_ranks")
def _(t):
    return _elements(bal.ranked_ballot(t.ballots), "ranks", "rank")


_APPROVED = """select voter_id, race, option, width, case when score > avg(score) over w + stddev_samp(score) over w
                      then 1 else 0 end as vote from ballot_long window w as (partition by voter_id)"""


@query("approval_ballot", ["ballot_long"], f"select voter_id, option, vote from ({_APPROVED}) a")
def _(t):
    return _elements(bal.approval_ballot(t.ballots), "approvals", "vote")


@query(
    "normalize_scores",
    ["ballot_long"],
    """select voter_id, option, round(coalesce(greatest(score, 0) / nullif(sum(greatest(score, 0))
              over (partition by voter_id), 0), 0), 6) as score from ballot_long""",
)
def _(t):
    return rounded(_elements(bal.normalize_scores(t.ballots), "scores", "score"), "score")


def _winner(source: str) -> str:
    return f"""select *, row_number() over (partition by race order by total desc, option) = 1 as is_winner
               from ({source}) s"""


_PLURALITY = """select race, option, count_if(rank = 1) as total,
                       round(count_if(rank = 1) * 100e0 / count(*), 6) as percent from ballot_ranks group by all"""
_APPROVAL = f"""select race, option, cast(sum(vote) as bigint) as total,
                       round(sum(vote) * 100e0 / count(*), 6) as percent from ({_APPROVED}) a group by all"""
_BORDA = """select race, option, cast(sum(width + 1 - rank) as bigint) as total, round(avg(width + 1 - rank), 6) as average
            from ballot_ranks group by all"""


@query("plurality_count", ["ballot_ranks"], _winner(_PLURALITY))
def _(t):
    return rounded(bal.plurality_count(t.ballots, RACE), "percent")


@query("approval_count", ["ballot_long"], _winner(_APPROVAL))
def _(t):
    return rounded(bal.approval_count(t.ballots, RACE), "percent")


@query("borda_count", ["ballot_ranks"], _winner(_BORDA))
def _(t):
    return rounded(bal.borda_count(t.ballots, RACE), "average")


@query(
    "rank_distribution",
    ["ballot_ranks"],
    """select race, option, r::int as "rank", coalesce(n, 0) as n
       from (select race, option, unnest(range(1, width + 1)) as r
             from (select race, option, max(width) as width from ballot_ranks group by all) w) g
            left join (select race, option, rank as r, count(*) as n from ballot_ranks group by all) c
            using (race, option, r)""",
)
def _(t):
    return bal.rank_distribution(t.ballots, RACE)


_PAIRS = """select x.race, x.option as a, y.option as b, count_if(x.score > y.score) as a_over_b,
                   count_if(y.score > x.score) as b_over_a, count(*) as ballots
            from ballot_long x join ballot_long y on x.voter_id = y.voter_id and x.option < y.option group by all"""
_WIDTHS = "widths as (select race, max(width) as width from ballot_long group by race)"


@query("pairwise", ["ballot_long"], _PAIRS)
def _(t):
    return bal.pairwise(t.ballots, RACE)


_DUELS = f"""pairs as ({_PAIRS}),
    duels as (select race, a as option, b as opponent, a_over_b as wins, b_over_a as losses, ballots from pairs
              union all select race, b, a, b_over_a, a_over_b, ballots from pairs)"""
_CONDORCET = """select race, option, count_if(wins > losses) as total, count_if(wins > losses) = max(width) - 1 as is_winner
                from duels join widths using (race) group by all"""


@query("condorcet", ["ballot_long"], f"with {_DUELS}, {_WIDTHS} {_CONDORCET}")
def _(t):
    return bal.condorcet(t.ballots, RACE)


@query(
    "pairwise_percent",
    ["ballot_long"],
    f"with {_DUELS} select race, option, opponent, round(wins * 100e0 / ballots, 6) as percent from duels",
)
def _(t):
    return rounded(bal.pairwise_percent(t.ballots, RACE), "percent")


# One step per round: the first remaining choices of each open race, then its top and its weakest.
_RUNOFF = """recursive rankings as (select race, voter_id, list(option order by rank) as ranking
                          from ballot_ranks group by all),
    rounds as (select race, count(*) as ballots, max(len(ranking)) as options, []::int[] as outs,
                      case when max(len(ranking)) = 1 then 0 end as winner from rankings group by race
        union all
        select race, ballots, options, case when top * 2 > ballots then outs else list_append(outs, low) end,
               case when top * 2 > ballots then best
                    when len(outs) + 2 = options then list_filter(standing, lambda o: o <> low)[1] end
        from (select s.race, s.ballots, s.options, s.outs,
                     list_filter(range(s.options)::int[], lambda o: not list_contains(s.outs, o)) as standing,
                     max(v.votes) as top, arg_min(v.option, (-v.votes, v.option)) as best,
                     arg_min(v.option, (v.votes, v.option)) as low
              from rounds s join (
                  select r.race, c.option, count_if(r.first = c.option) as votes
                  from (select s.race, list_filter(ranking, lambda o: not list_contains(s.outs, o))[1] as first
                        from rounds s join rankings using (race) where s.winner is null) r
                  join (select race, unnest(list_filter(range(options)::int[], lambda o: not list_contains(outs, o))) as option
                        from rounds where winner is null) c on c.race = r.race
                  group by all) v on v.race = s.race
              where s.winner is null group by all) x),
    ended as (select * from rounds where winner is not null)"""


@query(
    "instant_runoff",
    ["ballot_ranks"],
    f"""with {_RUNOFF} select race, winner, array_to_string(outs, ',') as elimination_order, cast(len(outs) as int) as rounds
        from ended""",
)
def _(t):
    result = bal.instant_runoff(t.ballots, RACE)
    order = F.array_join(F.transform("elimination_order", lambda o: o.cast("string")), ",")
    return result.withColumn("elimination_order", order)


@query(
    "method_results",
    ["ballot_ranks"],
    f"""with {_RUNOFF}, {_DUELS}, {_WIDTHS},
        p as ({_winner(_PLURALITY)}), a as ({_winner(_APPROVAL)}), b as ({_winner(_BORDA)}), c as ({_CONDORCET}),
        r as (select race, option, cast(nullif(list_position(outs, option), 0) as bigint) as total, option = winner as is_winner
              from (select *, unnest(range(options)::int[]) as option from ended) e)
        select race, 'plurality' as method, option, total, is_winner from p
        union all select race, 'approval', option, total, is_winner from a
        union all select race, 'borda', option, total, is_winner from b
        union all select race, 'condorcet', option, total, is_winner from c
        union all select race, 'instant_runoff', option, total, is_winner from r""",
)
def _(t):
    return bal.method_results(t.ballots, RACE)


@query(
    "sort_lexicographic",
    ["ballots"],
    """select voter_id, row_number() over (order by scores, voter_id) as place from ballots""",
)
def _(t):
    return placed(bal.sort_lexicographic(t.ballots.select("voter_id", "scores"))).select("voter_id", "place")


@query(
    "sort_by_top_choice",
    ["ballot_ranks"],
    """select voter_id, race, option as choice, row_number() over (order by option, voter_id) as place
       from ballot_ranks where rank = 1""",
)
def _(t):
    return placed(bal.sort_by_top_choice(t.ballots).select("voter_id", "race", "choice"))


@query(
    "ballot_matrix",
    ["ballot_ranks", "ballot_long"],
    f"""with a as ({_APPROVED}),
             top as (select voter_id, option as choice, row_number() over (order by option, voter_id) as place
                     from ballot_ranks where rank = 1)
        select r.voter_id, choice, place, r.option as at, round(score, 6) as value from ballot_ranks r join top using (voter_id)
        union all select r.voter_id, choice, place, cast(width as int) + r.option, case when rank = 1 then 1 else 0 end
                  from ballot_ranks r join top using (voter_id)
        union all select r.voter_id, choice, place, cast(2 * width as int) + r.option, round(rank / width::double, 6)
                  from ballot_ranks r join top using (voter_id)
        union all select a.voter_id, choice, place, cast(3 * width as int) + a.option, vote from a join top using (voter_id)
        """.replace("as at", 'as "at"'),
)
def _(t):
    rows = placed(bal.ballot_matrix(t.ballots).select("voter_id", "choice", "values"))
    return rounded(rows.select("voter_id", "choice", "place", F.posexplode("values").alias("at", "value")), "value")


@query(
    "distance_scores",
    ["ballot_ranks"],
    """with c as (select voter_id, option as choice from ballot_ranks where rank = 1),
            s as (select voter_id, choice, i::int as option, 1 / (1 + (i - choice) ** 2)::double as raw
                  from c, range(64) as o(i))
       select voter_id, choice, option, round(raw / sum(raw) over (partition by voter_id), 6) as score from s""",
)
def _(t):
    voters = bal.plurality_ballot(t.ballots).select("voter_id", "choice")
    scored = bal.distance_scores(voters, bal.line_positions(64))
    return rounded(_elements(scored, "scores", "score", "voter_id", "choice"), "score")


# Options as a definition would list them: more than 64, by a rule that both engines know.
_LISTED = [(i, [((i * 7 + d * 3) % 11 - 5) / 10 for d in range(64)]) for i in range(80)]
_NEAREST = """select id, option, round(d, 6) as distance
       from (select id, option, sqrt(list_sum(list_transform(list_zip(x, center), lambda p: (p[1] - p[2]) ** 2))) as d
             from points, options) z
       qualify row_number() over (partition by id order by d, option) = 1"""


@query(
    "nearest_option",
    ["points"],
    f"""with options as (select i::int as option, list_transform(range(64), lambda d: ((i * 7 + d * 3) % 11 - 5) / 10e0) as center
                         from range(80) as r(i)) {_NEAREST}""",
)
def _(t):
    return rounded(bal.nearest_option(t.points, _LISTED), "distance")


@query("nearest_option_in_table", ["points", "modes"], f"with options as (select mode_id as option, center from modes) {_NEAREST}")
def _(t):
    options = t.modes.select(F.col("mode_id").alias("option"), "center")
    return rounded(bal.nearest_option_in_table(t.points, options), "distance")
