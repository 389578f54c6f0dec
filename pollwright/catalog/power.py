"""Queries on seats: draws, terms, electors, distributions."""

from __future__ import annotations

from pollwright.catalog.registry import query, rounded
from pollwright.operators import aggregates as agg
from pollwright.operators import joins, lottery
from pollwright.operators import results as res
from pollwright.operators import standardize as std
from pollwright.plans import control

N = 200
SEED = 42


def _u(keys: list[str], prefix: list[str] = ()) -> str:
    """The uniform number of a replicate in SQL."""
    parts = ", ".join(
        [f"'{SEED}'", *prefix, "cast(replicate // 4 as varchar)"]
        + [f"coalesce(cast({k} as varchar), '')" for k in keys]
    )
    hex8 = f"substr(md5(concat_ws('|', {parts})), 1 + 8 * (replicate % 4), 8)"
    return f"(('0x' || {hex8})::ubigint / 4294967296e0)"


def _slices(source: str, race: list[str], ticket: list[str], votes: str, total: str) -> str:
    """Ticket slices of a source relation as CTE text ``tickets`` and ``slices``."""
    r, t = ", ".join(race), ", ".join(ticket)
    text = ", ".join(f"coalesce(cast({c} as varchar), '')" for c in ticket)
    order = ", ".join([f"substr(md5(concat_ws('|', {text})), 1, 3)"] + [f"{c} nulls first" for c in ticket])
    return f"""tickets as (select {r}, {t}, sum({votes}) as votes, max({total}) as total from {source} group by all),
    slices as (select *, sum(votes) over (partition by {r} order by {order} rows unbounded preceding) as upto,
                      sum(votes) over (partition by {r}) as race_votes, max(total) over (partition by {r}) as race_total,
                      case when votes = max(votes) over (partition by {r}) then 1 else 0 end as count_win
               from tickets)"""


def _drawn(keys: list[str], source: str = "slices", undervote: str = "none") -> str:
    """CTE ``drawn``: slices repeated per replicate with ``won``."""
    everyone = " or die > race_votes" if undervote == "all" else ""
    return f"""dice as (select *, {_u(keys)} * race_total as die from {source}, range({N}) as reps(replicate)),
    drawn as (select *, case when votes > 0 and die <= upto and (die > upto - votes or (die = 0 and upto = votes))
                        {everyone} then 1 else 0 end as won from dice)"""


# --- draws ------------------------------------------------------------------------------

_RACE = ["year", "state", "district"]


@query(
    "replicate_draws",
    ["elections"],
    f"""select *, round({_u(_RACE)}, 9) as u
        from (select distinct year, state, district from elections) r, range({N}) as reps(replicate)""",
)
def _(t):
    return rounded(lottery.replicate_draws(t.elections, _RACE, N, SEED), "u", places=9)


@query(
    "vote_slices",
    ["house"],
    "with "
    + _slices("house", _RACE, ["candidate"], "candidatevotes", "totalvotes")
    + """ select year, state, district, candidate, votes, upto - votes as below, upto, race_votes, race_total,
                 count_win from slices""",
)
def _(t):
    return lottery.vote_slices(t.house, _RACE, ["candidate"])


def _lottery_sql(undervote: str) -> str:
    return (
        "with "
        + _slices("house", _RACE, ["candidate"], "candidatevotes", "totalvotes")
        + ", "
        + _drawn(_RACE, undervote=undervote)
        + " select year, state, district, candidate, count_win, replicate, won from drawn"
    )


@query("lottery_winners", ["house"], _lottery_sql("none"))
def _(t):
    return lottery.lottery_winners(t.house, _RACE, ["candidate"], N, SEED)


@query("lottery_winners_undervote_all", ["house"], _lottery_sql("all"))
def _(t):
    return lottery.lottery_winners(t.house, _RACE, ["candidate"], N, SEED, undervote="all")


_HOUSE_ROWS = """rows_ as (select *, case when count(*) over w = 1 and coalesce(sum(candidatevotes) over w, 0) < 1
                                      then 1 else candidatevotes end as cv
                     from house where coalesce(state_po, '') <> 'DC' window w as (partition by year, state, district)),
    contested as (select year, state || '-' || district as state_district, candidate, coalesce(party, '') as party,
                         cv, totalvotes from rows_ where cv <> 0)"""
_HOUSE_DRAWN = (
    f"with {_HOUSE_ROWS}, "
    + _slices("contested", ["year", "state_district"], ["candidate", "party"], "cv", "totalvotes")
    + ", "
    + _drawn(["year", "state_district"])
    + """, winners as (select *, case when party in ('DEMOCRAT', 'REPUBLICAN') then party else 'OTHER' end
                              as party_major from drawn)"""
)
_HOUSE_SEATS = (
    _HOUSE_DRAWN
    + """, seats as (select year, party_major, replicate, cast(sum(won) as bigint) as seats,
                            cast(sum(count_win) as bigint) as count_win from winners group by all)"""
)


@query("house_control", ["house"], _HOUSE_SEATS + " select * from seats")
def house_seats(t):
    return control.house_control(t.house, N, SEED)


@query(
    "seat_counts",
    ["house"],
    _HOUSE_DRAWN
    + """ select year, party, replicate, cast(sum(won) as bigint) as seats, cast(sum(count_win) as bigint) as count_win
          from winners group by all""",
)
def _(t):
    return agg.seat_counts(control.house_winners(t.house, N, SEED), ["year", "party"])


@query(
    "seat_totals",
    ["house"],
    _HOUSE_SEATS + " select year, replicate, cast(sum(seats) as bigint) as seats from seats group by all",
)
def _(t):
    return agg.seat_totals(house_seats(t))


@query(
    "race_wins",
    ["house"],
    _HOUSE_DRAWN
    + """ select year, state_district, candidate, cast(sum(won) as bigint) as wins from winners
          where year = 1980 and state_district = 'NATION_1-BUILDING' group by all""",
)
def _(t):
    return agg.race_wins(control.house_winners(t.house, N, SEED), 1980, "NATION_1-BUILDING")


# A new-format file without race totals, from import to control.
_NEW_HOUSE = """new_house as (
        select *, sum(candidatevotes) over (partition by year, state, district) as totalvotes
        from (select cycle as year, upper(state) as state, state_abbrev as state_po, upper(candidate_name) as candidate,
                     case when regexp_matches(office_seat_name, 'District ([0-9]+)')
                          then lpad(regexp_extract(office_seat_name, 'District ([0-9]+)', 1), 3, '0') else '000' end
                     as district, upper(coalesce(ballot_party, '')) as party,
                     coalesce(try_cast(votes as double), 0) as candidatevotes from new_format) n)"""


@query(
    "house_control_new_format",
    ["new_format"],
    _HOUSE_SEATS.replace("with ", f"with {_NEW_HOUSE}, ", 1).replace("from house where", "from new_house where")
    + " select * from seats",
)
def _(t):
    return control.house_control(std.import_election(t.new_format, "house"), N, SEED)


# --- Senate terms -----------------------------------------------------------------------

_YEAR_CLASS = "cast(floor(((year - 1976) / 2.0) % 3) as int) + 1"
_TERMS = f"""classed as (select *, {_YEAR_CLASS} as yc from senate),
    regular as (select * from classed where not (special and class <> yc)),
    specials as (select *, (class - yc + 3) % 3 as class_diff, (yc - class + 3) % 3 as back,
                        year - year % 2 - 2 * ((yc - class + 3) % 3) as original_year
                 from classed where special and class <> yc),
    carried as (select * replace (year + o as year), year as election_year, o as election_cur
                from regular, unnest([0, 2, 4]) as offsets(o)),
    kept as (select * from carried c where not exists (
                select 1 from specials s where c.year >= s.year and c.election_year = s.original_year
                                           and c.state = s.state and c.class = s.class)),
    special_carried as (select * replace (year + o as year), year as election_year, o as election_cur
                        from specials, unnest([0, 2]) as offsets(o) where o = 0 or class_diff = 2)"""


@query(
    "carry_forward",
    ["senate"],
    f"with {_TERMS} select year, state, class, candidate, election_year, election_cur from carried",
)
def _(t):
    regular, _special = res.split_special(res.senate_class_columns(t.senate))
    rows = joins.carry_forward(regular)
    return rows.select("year", "state", "class", "candidate", "election_year", "election_cur")


@query(
    "carry_special",
    ["senate"],
    f"""with {_TERMS} select year, state, class, candidate, election_year, election_cur, class_diff,
             back as class_diff_backward, year - year % 2 - 2 * back as original_year from special_carried""",
)
def _(t):
    _regular, special = res.split_special(res.senate_class_columns(t.senate))
    return joins.carry_special(special).select(
        "year", "state", "class", "candidate", "election_year", "election_cur",
        "class_diff", "class_diff_backward", "original_year",
    )


@query(
    "drop_superseded",
    ["senate"],
    f"with {_TERMS} select year, state, class, candidate, election_year from kept",
)
def _(t):
    regular, special = res.split_special(res.senate_class_columns(t.senate))
    rows = joins.drop_superseded(joins.carry_forward(regular), special)
    return rows.select("year", "state", "class", "candidate", "election_year")


_SENATE_SEATS = (
    f"""with contested as (select year, state, state || '-' || district as state_district, class, special, candidate,
                                  party_simplified, candidatevotes, totalvotes from senate
                           where state_po <> 'DC' and candidatevotes <> 0), """
    + _slices(
        "contested",
        ["year", "state_district", "class"],
        ["candidate", "party_simplified", "state", "year_class", "actually_special"],
        "candidatevotes",
        "totalvotes",
    )
    .replace("from contested", "from marked")
    .replace("tickets as", f"""marked as (select *, {_YEAR_CLASS} as year_class,
                                     special and class <> {_YEAR_CLASS} as actually_special from contested),
    tickets as""", 1)
    + ", "
    + _TERMS.replace("from senate", "from slices")
    .replace("special and class <> yc", "actually_special")
    .replace("select *, " + _YEAR_CLASS + " as yc", "select *, year_class as yc")
    + """, current_ as (select year, election_year, state_district, state, class, candidate, party_simplified,
                             votes, upto, race_votes, race_total, count_win from kept
                      union all
                      select year, election_year, state_district, state, class, candidate, party_simplified,
                             votes, upto, race_votes, race_total, count_win from special_carried), """
    + _drawn(["election_year", "state_district", "class"], "current_")
    + """, winners as (select *, year + year % 2 as eff_year from drawn),
    seats as (select eff_year, party_simplified, replicate, cast(sum(won) as bigint) as seats,
                     cast(sum(count_win) as bigint) as count_win from winners group by all)"""
)


@query("senate_control", ["senate"], _SENATE_SEATS + " select * from seats")
def senate_seats(t):
    return control.senate_control(t.senate, N, SEED)


@query(
    "seats_by_state",
    ["senate"],
    _SENATE_SEATS
    + """ select eff_year, state, replicate, cast(sum(won) as bigint) as seats,
                 cast(sum(count_win) as bigint) as count_win from winners group by all""",
)
def _(t):
    return agg.seats_by_state(control.senate_winners(t.senate, N, SEED))


@query(
    "seat_totals_senate",
    ["senate"],
    _SENATE_SEATS + " select eff_year, replicate, cast(sum(seats) as bigint) as seats from seats group by all",
)
def _(t):
    return agg.seat_totals(senate_seats(t), "eff_year")


@query(
    "seat_distribution_house",
    ["house"],
    _HOUSE_SEATS
    + """ select year, party_major, round(coalesce(avg(seats), 0), 6) as mean_seats, coalesce(max(count_win), 0) as count_win
          from (select distinct year from seats) y
               cross join unnest(['DEMOCRAT', 'REPUBLICAN', 'OTHER']) as p(party_major)
               left join seats using (year, party_major) group by all""",
)
def _(t):
    return rounded(
        agg.seat_distribution(house_seats(t), agg.HOUSE_PARTIES, "year", "party_major"), "mean_seats"
    )


_DISTRIBUTION = (
    _SENATE_SEATS
    + """, distribution as (
        select eff_year, party_simplified, coalesce(avg(seats), 0) as mean_seats, coalesce(max(count_win), 0) as count_win
        from (select distinct eff_year from seats) y
             cross join unnest(['DEMOCRAT', 'REPUBLICAN', 'OTHER', 'LIBERTARIAN']) as p(party_simplified)
             left join seats using (eff_year, party_simplified) group by all)"""
)


@query(
    "seat_distribution",
    ["senate"],
    _DISTRIBUTION + " select eff_year, party_simplified, round(mean_seats, 6) as mean_seats, count_win from distribution",
)
def _(t):
    return rounded(agg.seat_distribution(senate_seats(t)), "mean_seats")


_HISTOGRAM = """, ranged as (select year, party_major, seats, min(seats) over (partition by year)::double as lo,
                                   max(seats) over (partition by year)::double as hi from seats),
    edged as (select year, party_major, seats, case when lo = hi then lo - 0.5 else lo end as low,
                     (case when lo = hi then 1e0 else hi - lo end) / 60 as width from ranged),
    counted as (select year, party_major, least(floor((seats - low) / width), 59)::int as bin, count(*) as n
                from edged group by all),
    bins as (select distinct year, party_major, low, width, b::int as bin from edged, range(60) as r(b))
    select year, party_major, bin, round(low + bin * width, 6) as edge_low,
           round(low + (bin + 1) * width, 6) as edge_high, coalesce(n, 0) as n
    from bins left join counted using (year, party_major, bin)"""


@query("seat_histogram", ["house"], _HOUSE_SEATS + _HISTOGRAM)
def _(t):
    return rounded(agg.seat_histogram(house_seats(t), 60, "year", "party_major"), "edge_low", "edge_high")


@query(
    "seat_stack",
    ["senate"],
    _DISTRIBUTION
    + """, y as (select eff_year, sum(case when party_simplified = 'DEMOCRAT' then count_win end)::double as d,
                        sum(case when party_simplified = 'OTHER' then count_win end)::double as o,
                        sum(case when party_simplified = 'LIBERTARIAN' then count_win end)::double as l,
                        sum(case when party_simplified = 'REPUBLICAN' then count_win end)::double as r
                 from distribution group by eff_year)
        select eff_year, 'DEMOCRAT' as party_simplified, 0e0 as lower, d as upper from y
        union all select eff_year, 'OTHER', d, d + o from y
        union all select eff_year, 'LIBERTARIAN', d + o, d + o + l from y
        union all select eff_year, 'REPUBLICAN', 100 - r, 100 from y""".replace("as lower", 'as "lower"').replace(
        "as upper", 'as "upper"'
    ),
)
def _(t):
    return agg.seat_stack(agg.seat_distribution(senate_seats(t)))


# --- electors ---------------------------------------------------------------------------

_ELECTORS = """seats_ as (select year, state_po, count(distinct district) as e from house
                         where (year - 1976) % 4 = 0 group by all),
    pres as (select president.*, coalesce(e, 0) + 2 + case when state_po = 'DC' then 1 else 0 end as electors
             from president left join seats_ using (year, state_po))"""


@query(
    "attach_electors",
    ["president", "house"],
    f"with {_ELECTORS} select year, state_po, candidate, electors from pres",
)
def _(t):
    return joins.attach_electors(t.president, t.house).select("year", "state_po", "candidate", "electors")


@query(
    "electoral_votes",
    ["president", "house"],
    f"""with {_ELECTORS}, tops as (select * from pres qualify row_number() over (
               partition by year, state_po order by candidatevotes desc, candidate) = 1)
        select year, candidate, cast(sum(electors) as bigint) as electoral_votes from tops group by all""",
)
def _(t):
    return agg.electoral_votes(joins.attach_electors(t.president, t.house))


@query(
    "elector_lottery",
    ["president", "house"],
    f"with {_ELECTORS}, "
    + _slices("pres", ["year", "state_po"], ["candidate"], "candidatevotes", "totalvotes")
    + f""", held as (select slices.*, electors from slices
                     join (select distinct year, state_po, electors from pres) e using (year, state_po)),
    each as (select held.*, elector from held, unnest(range(1, electors + 1)) as u(elector)),
    dice as (select *, {_u(["year", "state_po"], ["'elector'", "cast(elector as varchar)"])} * race_total as die
             from each, range({N}) as reps(replicate)),
    drawn as (select *, case when votes > 0 and die <= upto and (die > upto - votes or (die = 0 and upto = votes))
                        then 1 else 0 end as won from dice)
    select year, candidate, replicate, cast(sum(won) as bigint) as electors from drawn group by all""",
)
def _(t):
    return control.elector_lottery(t.president, t.house, N, SEED)


# --- nearest survey ---------------------------------------------------------------------


@query(
    "align_nearest",
    ["survey", "elections"],
    """with targets as (select distinct year, make_date(year, 11, 1) as d from elections),
            near as (select t.year, arg_min(s.date, (abs(s.date - t.d), s.date)) as survey_date
                     from targets t, survey s group by t.year)
       select e.year, e.state, e.district, e.candidate, e.votes, near.survey_date,
              round(s.republicans, 6) as republicans, round(s.democrats, 6) as democrats
       from elections e join near on e.year = near.year join survey s on s.date = near.survey_date""",
)
def _(t):
    rows = t.elections.select("year", "state", "district", "candidate", "votes")
    aligned = joins.align_nearest(t.survey.select("date", "republicans", "democrats"), rows)
    return rounded(aligned, "republicans", "democrats")
