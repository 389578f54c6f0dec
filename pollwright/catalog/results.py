"""Queries over result tables: filters, standard schema, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwright.catalog.registry import placed, query, rounded
from pollwright.operators import aggregates as agg
from pollwright.operators import results as res
from pollwright.operators import standardize as std
from pollwright.operators import windows as win

# --- filters and projections ------------------------------------------------------------


@query(
    "filter_in",
    ["elections"],
    """select year, state, district, candidate, votes from elections
       where year in (1996, 1998) and state in ('NATION_1', 'NATION_2') and district in ('BUILDING', 'MACHINERY')""",
)
def _(t):
    kept = res.filter_in(t.elections, "1996,1998", ["NATION_1", "NATION_2"], "BUILDING,MACHINERY")
    return kept.select("year", "state", "district", "candidate", "votes")


@query(
    "general_only",
    ["house"],
    "select year, state, district, candidate, stage from house where upper(stage) in ('GEN', 'GENERAL')",
)
def _(t):
    return res.general_only(t.house).select("year", "state", "district", "candidate", "stage")


@query(
    "general_only_strict",
    ["house"],
    "select year, state, district, candidate, stage from house where stage = 'GEN'",
)
def _(t):
    return res.general_only(t.house, strict=True).select("year", "state", "district", "candidate", "stage")


@query(
    "exclude_states",
    ["house"],
    "select year, state, state_po, district, candidate from house where coalesce(state_po, '') <> 'DC'",
)
def _(t):
    return res.exclude_states(t.house).select("year", "state", "state_po", "district", "candidate")


@query(
    "drop_zero_votes",
    ["house"],
    "select year, state, district, candidate, candidatevotes from house where candidatevotes <> 0",
)
def _(t):
    return res.drop_zero_votes(t.house).select("year", "state", "district", "candidate", "candidatevotes")


@query(
    "fill_blank",
    ["new_format"],
    """select race_id, state, coalesce(ballot_party, 'Blank') as ballot_party,
              coalesce(try_cast(votes as double), 0) as votes from new_format""",
)
def _(t):
    rows = t.new_format.select("race_id", "state", "ballot_party", F.col("votes").try_cast("double").alias("votes"))
    return res.fill_blank(rows, votes=["votes"])


@query(
    "require_columns",
    ["elections"],
    """select year, state, '' as state_po, district, '' as stage, '' as runoff, '' as special, candidate,
              party, '' as writein, '' as mode, '' as candidatevotes, '' as totalvotes from elections""",
)
def _(t):
    return res.require_columns(t.elections, "house")


@query(
    "party_major",
    ["elections"],
    """select year, state, district, candidate,
              case when party in ('DEMOCRAT', 'REPUBLICAN') then party else 'OTHER' end as party_major
       from elections""",
)
def _(t):
    return res.party_major(t.elections).select("year", "state", "district", "candidate", "party_major")


@query(
    "state_district",
    ["elections"],
    "select year, candidate, state || '-' || district as state_district from elections",
)
def _(t):
    return res.state_district(t.elections).select("year", "candidate", "state_district")


@query(
    "fix_unopposed",
    ["house"],
    """select year, state, district, candidate,
              case when n = 1 and s < 1 then 1 else candidatevotes end as candidatevotes,
              case when n = 1 and s < 1 then 1 else 0 end as unopposed
       from (select *, count(*) over w as n, coalesce(sum(candidatevotes) over w, 0) as s
             from house window w as (partition by year, state, district)) r""",
)
def _(t):
    fixed = res.fix_unopposed(t.house, ["year", "state", "district"])
    return fixed.select("year", "state", "district", "candidate", "candidatevotes", "unopposed")


@query(
    "senate_class_columns",
    ["senate"],
    """select year, state, candidate, class,
              cast(floor(((year - 1976) / 2.0) % 3) as int) + 1 as year_class,
              special and class <> cast(floor(((year - 1976) / 2.0) % 3) as int) + 1 as actually_special
       from senate""",
)
def _(t):
    rows = res.senate_class_columns(t.senate)
    return rows.select("year", "state", "candidate", "class", "year_class", "actually_special")


@query(
    "effective_year",
    ["elections"],
    "select year, state, district, candidate, year + year % 2 as eff_year from elections",
)
def _(t):
    return res.effective_year(t.elections).select("year", "state", "district", "candidate", "eff_year")


@query(
    "vote_shares",
    ["elections"],
    "select year, state, party, round(votes / cast(total_votes as double) * 100, 6) as vote_share from elections",
)
def _(t):
    return rounded(res.vote_shares(t.elections), "vote_share")


@query(
    "newer_than",
    ["old_results", "new_results"],
    """select year, state, candidate, seq, round(candidatevotes, 4) as candidatevotes from old_results
       union all
       select year, state, candidate, seq, round(candidatevotes, 4) from new_results
       where year > (select max(year) from old_results)""",
)
def _(t):
    rows = res.newer_than(t.new_results, t.old_results)
    return rounded(rows.select("year", "state", "candidate", "seq", "candidatevotes"), "candidatevotes", places=4)


@query(
    "presidential_years",
    ["house"],
    "select year, state, district, candidate from house where (year - 1976) % 4 = 0",
)
def _(t):
    return res.presidential_years(t.house).select("year", "state", "district", "candidate")


@query(
    "two_party_heatmap",
    ["elections"],
    """with s as (select year, state, party, votes / cast(total_votes as double) * 100 as vote_share from elections),
            two as (select * from s where party in ('DEMOCRAT', 'REPUBLICAN') and vote_share > 0)
       select year, state, party, round(vote_share, 6) as vote_share from two
       where state in (select distinct state from two order by state limit 20)""",
)
def _(t):
    return rounded(res.two_party_heatmap(res.vote_shares(t.elections)), "vote_share")


@query(
    "first_states",
    ["elections"],
    "select distinct state from elections order by state limit 20",
)
def _(t):
    return res.first_states(t.elections, 20)


@query(
    "drop_last_years",
    ["elections"],
    """select year, state, district, candidate from elections
       where year < (select min(year) from (select distinct year from elections order by year desc limit 3) y)""",
)
def _(t):
    kept = res.drop_last_years(t.elections, 3, year="year")
    return kept.select("year", "state", "district", "candidate")


@query(
    "split_special",
    ["senate"],
    """select year, state, candidate, case when special then 'special' else 'regular' end as part from senate""",
)
def _(t):
    regular, special = res.split_special(res.senate_class_columns(t.senate))
    parts = regular.withColumn("part", F.lit("regular")).union(special.withColumn("part", F.lit("special")))
    return parts.select("year", "state", "candidate", "part")


@query(
    "union_results",
    ["old_results", "new_results"],
    """select year, state, candidate, district, seq, null as mode from old_results
       union all select year, state, candidate, district, seq, 'TOTAL' from new_results""",
)
def _(t):
    new = t.new_results.withColumn("mode", F.lit("TOTAL"))
    return res.union_results(t.old_results, new).select("year", "state", "candidate", "district", "seq", "mode")


@query("distinct_rows", ["elections"], "select distinct year, state from elections")
def _(t):
    return res.distinct_rows(t.elections, ["year", "state"])


@query(
    "sort_results",
    ["house"],
    """select year, state, district, candidate, candidatevotes,
              row_number() over (order by year, state, district, candidatevotes desc, candidate) as place from house""",
)
def _(t):
    columns = ["year", "state", "district", "candidate", "candidatevotes"]
    return placed(res.sort_results(t.house.select(*columns), "house"))


# --- standard schema --------------------------------------------------------------------

_VOTES = "coalesce(try_cast(votes as double), 0)"
_DISTRICT = """case when regexp_matches(office_seat_name, 'District ([0-9]+)')
                    then lpad(regexp_extract(office_seat_name, 'District ([0-9]+)', 1), 3, '0') else '000' end"""


@query(
    "is_new_format",
    ["new_format", "old_format"],
    """select 'new_format' as source, true as is_new, count(*) as n from new_format
       union all select 'old_format', false, count(*) from old_format""",
)
def _(t):
    def flagged(name):
        df = getattr(t, name)
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("source"), F.lit(std.is_new_format(df)).alias("is_new"), "n"
        )

    return flagged("new_format").union(flagged("old_format"))


@query(
    "standardize_by_mapping_house",
    ["new_format"],
    f"""select cycle as year, upper(state) as state, upper(state_abbrev) as state_po,
               case when regexp_matches(office_seat_name, 'District ([0-9]+)')
                    then lpad(regexp_extract(office_seat_name, 'District ([0-9]+)', 1), 3, '0') else '000' end as district,
               stage, special, upper(candidate_name) as candidate, upper(coalesce(ballot_party, '')) as party,
               {_VOTES} as candidatevotes, coalesce(ballot_party, '') = 'W' as writein, 'TOTAL' as mode,
               'FALSE' as runoff from new_format""",
)
def _(t):
    return std.standardize_by_mapping(t.new_format, "house")


@query(
    "standardize_by_mapping_senate",
    ["new_format"],
    f"""select cycle as year,
               case when regexp_matches(office_seat_name, 'Class ([0-9]+)')
                    then regexp_extract(office_seat_name, 'Class ([0-9]+)', 1) else '0' end as class,
               upper(state) as state, upper(state_abbrev) as state_po, 'statewide' as district, stage, special,
               upper(candidate_name) as candidate, upper(coalesce(ballot_party, '')) as party,
               {_VOTES} as candidatevotes, coalesce(ballot_party, '') = 'W' as writein, 'TOTAL' as mode
        from new_format""",
)
def _(t):
    return std.standardize_by_mapping(t.new_format, "senate")


@query(
    "standardize_new_format_house",
    ["new_format"],
    """select race_id, cycle as year, state, state_abbrev as state_po, upper(coalesce(ballot_party, '')) as party,
              upper(coalesce(ballot_party, '')) = 'W' as writein, 'TOTAL' as mode, upper(stage) as stage,
              upper(cast(special as varchar)) as special, 'FALSE' as runoff,
              case when regexp_matches(office_seat_name, 'District ([0-9]+)')
                   then lpad(regexp_extract(office_seat_name, 'District ([0-9]+)', 1), 3, '0') else '000' end as district,
              candidate_name as candidate, votes as candidatevotes from new_format""",
)
def _(t):
    return std.standardize_new_format(t.new_format, "house").drop("office_seat_name")


@query(
    "standardize_new_format_senate",
    ["new_format"],
    """select race_id, cycle as year, 'statewide' as district,
              case when regexp_matches(office_seat_name, 'Class ([0-9]+)')
                   then cast(regexp_extract(office_seat_name, 'Class ([0-9]+)', 1) as int) else 0 end as class
       from new_format""",
)
def _(t):
    return std.standardize_new_format(t.new_format, "senate").select("race_id", "year", "district", "class")


@query(
    "standardize_old_format",
    ["old_format"],
    """select year, state, candidate, cast(floor((year - 1976) / 2.0) % 3 as int) + 1 as class, false as writein,
              'TOTAL' as mode, 'statewide' as district from old_format""",
)
def _(t):
    rows = std.standardize_old_format(t.old_format, "senate")
    return rows.select("year", "state", "candidate", "class", "writein", "mode", "district")


@query(
    "import_election_senate",
    ["old_format"],
    """select year, upper(state) as state, state_po, 'statewide' as district,
              cast(floor((year - 1976) / 2.0) % 3 as int) + 1 as class, stage, special, upper(candidate) as candidate,
              upper(coalesce(party, '')) as party, false as writein, 'TOTAL' as mode,
              coalesce(try_cast(candidatevotes as double), 0) as candidatevotes,
              cast(totalvotes as double) as totalvotes from old_format""",
)
def _(t):
    return std.import_election(t.old_format, "senate")


@query(
    "import_election_house",
    ["new_format"],
    f"""select cycle as year, upper(state) as state, state_abbrev as state_po,
               case when regexp_matches(office_seat_name, 'District ([0-9]+)')
                    then lpad(regexp_extract(office_seat_name, 'District ([0-9]+)', 1), 3, '0') else '000' end as district,
               upper(stage) as stage, 'FALSE' as runoff, upper(cast(special as varchar)) as special,
               upper(candidate_name) as candidate, upper(coalesce(ballot_party, '')) as party,
               coalesce(ballot_party, '') = 'W' as writein, 'TOTAL' as mode, {_VOTES} as candidatevotes,
               sum({_VOTES}) over (partition by cycle, upper(state), {_DISTRICT}) as totalvotes from new_format""",
)
def _(t):
    return std.import_election(t.new_format, "house")


_PRESIDENT_NEW = f"""select cycle as year, upper(state) as state, upper(state_abbrev) as state_po,
               upper(candidate_name) as candidate, upper(coalesce(ballot_party, '')) as party, {_VOTES} as candidatevotes,
               coalesce(ballot_party, '') = 'W' as writein"""


@query("standardize_by_mapping_president", ["new_format"], _PRESIDENT_NEW + ", 'TOTAL' as mode from new_format")
def _(t):
    return std.standardize_by_mapping(t.new_format, "president")


@query(
    "standardize_by_mapping_old_format",
    ["old_format"],
    """select year, upper(state) as state, upper(state_po) as state_po, stage, special, upper(candidate) as candidate,
              upper(coalesce(party, '')) as party, coalesce(try_cast(candidatevotes as double), 0) as candidatevotes,
              cast(totalvotes as double) as totalvotes from old_format""",
)
def _(t):
    return std.standardize_by_mapping(t.old_format.withColumnRenamed("party", "party_detailed"), "house")


@query(
    "import_election_president",
    ["new_format"],
    _PRESIDENT_NEW.replace("upper(state_abbrev)", "state_abbrev")
    + f", sum({_VOTES}) over (partition by cycle, upper(state)) as totalvotes from new_format",
)
def _(t):
    return std.import_election(t.new_format, "president")


def _chain_sql(office: str, seat: str, seat_sql: str) -> str:
    """Both generations imported, the newer row of a key kept, and the race totals checked."""
    return f"""with imported as (
            select year, upper(state) as state, upper(candidate) as candidate, upper(coalesce(party, '')) as party,
                   {'cast(floor((year - 1976) / 2.0) % 3 as int) + 1' if office == 'senate' else "'000'"} as {seat},
                   coalesce(try_cast(candidatevotes as double), 0) as candidatevotes,
                   cast(totalvotes as double) as totalvotes, special, 0 as source from old_format
            union all
            select cycle, upper(state), upper(candidate_name), upper(coalesce(ballot_party, '')), {seat_sql}, {_VOTES},
                   sum({_VOTES}) over (partition by cycle, upper(state), {seat_sql}), special, 1 from new_format),
        kept as (select * from imported qualify row_number() over (
                     partition by year, state, candidate, party, {seat}
                     order by source desc, candidatevotes desc, totalvotes desc, special desc) = 1),
        races as (select sum(candidatevotes) as s, min(totalvotes) as lo, max(totalvotes) as hi
                  from kept group by year, state, {seat})
        select 'race_totals' as "check", count_if(s <> lo or s <> hi) as offending, count_if(s <> lo or s <> hi) = 0 as passed
        from races union all select 'rows', count(*), true from kept"""


def _chain(t, office: str, seat: str):
    old, new = std.import_election(t.old_format, office), std.import_election(t.new_format, office)
    # The special flags come as different texts; what is compared must not depend on them.
    merged = win.merge_keep_latest(old, new, office, sequence=["candidatevotes", "totalvotes"])
    checks = std.validate(merged, office, keys=["year", "state", seat]).where(F.col("check") == "race_totals")
    rows = merged.agg(F.lit("rows").alias("check"), F.count("*").alias("offending"), F.lit(True).alias("passed"))
    return checks.unionByName(rows)


@query("import_merge_validate_house", ["old_format", "new_format"], _chain_sql("house", "district", _DISTRICT))
def _(t):
    return _chain(t, "house", "district")


@query(
    "import_merge_validate_senate",
    ["old_format", "new_format"],
    _chain_sql(
        "senate",
        "class",
        """case when regexp_matches(office_seat_name, 'Class ([0-9]+)')
                    then cast(regexp_extract(office_seat_name, 'Class ([0-9]+)', 1) as int) else 0 end""",
    ),
)
def _(t):
    return _chain(t, "senate", "class")


@query(
    "derive_totalvotes",
    ["house"],
    """select year, state, district, candidate, candidatevotes,
              sum(candidatevotes) over (partition by year, state, district) as totalvotes from house""",
)
def _(t):
    rows = t.house.select("year", "state", "district", "candidate", "candidatevotes")
    return std.derive_totalvotes(rows)


@query(
    "validate_house",
    ["house"],
    """select 'required_columns' as check, cast(0 as bigint) as offending, true as passed
       union all select 'numeric_votes', count_if(candidatevotes is null), count_if(candidatevotes is null) = 0 from house
       union all select 'nonnegative_votes', count_if(candidatevotes < 0), count_if(candidatevotes < 0) = 0 from house
       union all select 'race_totals', count_if(s <> t), count_if(s <> t) = 0
       from (select sum(candidatevotes) as s, max(totalvotes) as t from house group by year, state, district) r""".replace(
        "as check", 'as "check"'
    ),
)
def _(t):
    return std.validate(t.house, "house")


@query(
    "validate_senate",
    ["old_format"],
    """with r as (select *, year % 5 as class, 'statewide' as district from old_format)
       select 'required_columns' as "check", cast(0 as bigint) as offending, true as passed
       union all select 'numeric_votes', count_if(bad), count_if(bad) = 0
       from (select try_cast(candidatevotes as double) is null as bad from r) a
       union all select 'nonnegative_votes', count_if(bad), count_if(bad) = 0
       from (select coalesce(try_cast(candidatevotes as double) < 0, false) as bad from r) a
       union all select 'senate_class', count_if(bad), count_if(bad) = 0 from (select class not between 1 and 3 as bad from r) a
       union all select 'race_totals', count_if(coalesce(s, 0) <> lo or coalesce(s, 0) <> hi),
                        count_if(coalesce(s, 0) <> lo or coalesce(s, 0) <> hi) = 0
       from (select sum(try_cast(candidatevotes as double)) as s, min(totalvotes) as lo, max(totalvotes) as hi
             from r group by year, state, district) g""",
)
def _(t):
    rows = t.old_format.withColumn("class", F.col("year") % 5).withColumn("district", F.lit("statewide"))
    return std.validate(rows, "senate")


# --- aggregates -------------------------------------------------------------------------


@query(
    "votes_by_year",
    ["elections"],
    "select year, party, cast(sum(votes) as bigint) as votes from elections where party is not null group by all",
)
def _(t):
    return agg.votes_by_year(t.elections)


@query(
    "votes_by_state",
    ["elections"],
    "select state, party, cast(sum(votes) as bigint) as votes from elections where party is not null group by all",
)
def _(t):
    return agg.votes_by_state(t.elections)


@query(
    "votes_by_year_state",
    ["elections"],
    """select year, state, party, cast(sum(votes) as bigint) as votes from elections
       where party is not null group by all""",
)
def _(t):
    return agg.votes_by_year_state(t.elections)


_PARTIES = ["DEMOCRAT", "GREEN", "LIBERTARIAN", "REPUBLICAN"]


def _pivot_sql(source: str, value: str) -> str:
    columns = ", ".join(
        f"round(coalesce(avg(case when party = '{p}' then {value} end), 0), 6) as {p.lower()}" for p in _PARTIES
    )
    return f"select year, state, {columns} from {source} where party is not null group by year, state"


def _lower(df):
    return rounded(df.withColumnsRenamed({p: p.lower() for p in _PARTIES}), *[p.lower() for p in _PARTIES])


@query("pivot_vote_shares", ["shares"], _pivot_sql("shares", "vote_share"))
def _(t):
    return _lower(agg.pivot_vote_shares(t.shares, _PARTIES))


@query(
    "mean_vote_shares",
    ["shares"],
    """select year, state, party, round(avg(vote_share), 6) as vote_share from shares
       where party is not null group by all""",
)
def _(t):
    return rounded(agg.mean_vote_shares(t.shares), "vote_share")


@query(
    "district_shares",
    ["elections"],
    """select year, district, party, cast(sum(votes) as bigint) as votes, max(total_votes) as total_votes,
              round(sum(votes) / cast(max(total_votes) as double) * 100, 6) as vote_share
       from elections where party is not null group by year, district, party""",
)
def _(t):
    return rounded(agg.district_shares(t.elections, ["year", "district"]), "vote_share")


@query(
    "aggregate_district",
    ["elections"],
    "with g as (select year, state, party, sum(votes) / cast(max(total_votes) as double) * 100 as vote_share "
    "from elections where party is not null group by year, state, party) " + _pivot_sql("g", "vote_share"),
)
def _(t):
    return _lower(agg.aggregate_district(t.elections, parties=_PARTIES))


@query(
    "available_years_states",
    ["elections"],
    """select *, row_number() over (order by kind, value) as place
       from (select distinct 'year' as kind, cast(year as varchar) as value from elections
             union all select distinct 'state', state from elections) v""",
)
def _(t):
    return placed(agg.available_years_states(t.elections))


@query(
    "races_in_year",
    ["elections"],
    "select distinct state || '-' || district as state_district from elections where year = 1998",
)
def _(t):
    return agg.races_in_year(res.state_district(t.elections), 1998)


@query(
    "electors_by_state",
    ["house"],
    """select year, state_po, count(distinct district) as electors from house
       where (year - 1976) % 4 = 0 group by year, state_po""",
)
def _(t):
    return agg.electors_by_state(t.house)


# --- windows and merge ------------------------------------------------------------------


@query(
    "running_votes",
    ["house"],
    """select year, state, district, candidate, candidatevotes,
              sum(candidatevotes) over (partition by year, state, district order by candidate
                                        rows unbounded preceding) as cumsum from house""",
)
def _(t):
    rows = t.house.select("year", "state", "district", "candidate", "candidatevotes")
    return win.running_votes(rows, ["year", "state", "district"], ["candidate"])


@query(
    "count_winner",
    ["elections"],
    """select year, state, district, candidate, votes,
              case when votes = max(votes) over (partition by year, state, district) then 1 else 0 end as count_win
       from elections""",
)
def _(t):
    rows = t.elections.select("year", "state", "district", "candidate", "votes")
    return win.count_winner(rows, ["year", "state", "district"], "votes")


@query(
    "attach_race_totals",
    ["house"],
    """select year, state, district, candidate, totalvotes,
              max(totalvotes) over (partition by year, state, district) as race_total from house""",
)
def _(t):
    rows = t.house.select("year", "state", "district", "candidate", "totalvotes")
    return win.attach_race_totals(rows, ["year", "state", "district"])


_MERGED = """with b as (select *, 0 as src from old_results union all select *, 1 from new_results)
       select year, state, candidate, party, {seat}seq, round(candidatevotes, 4) as candidatevotes from b
       qualify row_number() over (partition by year, state, candidate, party{key}
                                  order by src desc, seq desc) = 1"""


@query(
    "merge_keep_latest_house",
    ["old_results", "new_results"],
    _MERGED.format(seat="district, ", key=", district"),
)
def _(t):
    merged = win.merge_keep_latest(t.old_results, t.new_results, "house", sequence=["seq"])
    return rounded(merged, "candidatevotes", places=4)


@query("merge_keep_latest_president", ["old_results", "new_results"], _MERGED.format(seat="", key=""))
def _(t):
    merged = win.merge_keep_latest(t.old_results, t.new_results, "president", sequence=["seq"])
    return rounded(merged.drop("district"), "candidatevotes", places=4)


def _filled(value: str) -> str:
    """Linear by position between the known neighbours of a grid row."""
    return f"""round(case when {value} is not null then {value} when l_{value} is null then null
               when r_{value} is null then l_{value}
               else l_{value} + (r_{value} - l_{value}) * (pos - la_{value}) / (ra_{value} - la_{value}) end, 6) as {value}"""


def _neighbours(value: str, keys: str = "") -> str:
    down = f"over ({keys}order by date rows unbounded preceding)"
    up = f"over ({keys}order by date rows between current row and unbounded following)"
    known = f"case when {value} is not null then pos end"
    return f"""last_value({value} ignore nulls) {down} as l_{value}, first_value({value} ignore nulls) {up} as r_{value},
               last_value({known} ignore nulls) {down} as la_{value}, first_value({known} ignore nulls) {up} as ra_{value}"""


_SHARES = ["republicans", "independents", "democrats"]


@query(
    "interpolate_monthly",
    ["gappy_survey"],
    f"""with g as (select cast(unnest(generate_series(min(date), max(date), interval 1 month)) as date) as date
                    from gappy_survey),
             f as (select g.date, {', '.join(_SHARES)}, row_number() over (order by g.date) as pos
                   from g left join gappy_survey s on g.date = s.date),
             n as (select *, {', '.join(_neighbours(v) for v in _SHARES)} from f)
        select date, {', '.join(_filled(v) for v in _SHARES)} from n""",
)
def _(t):
    return rounded(win.interpolate_monthly(t.gappy_survey, "date", _SHARES), *_SHARES)


@query(
    "interpolate_daily_series",
    ["orders"],
    f"""with k as (select o_orderpriority as series, cast(o_orderdate as date) as date, avg(o_totalprice) as price
                   from orders group by all),
             g as (select series, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
                   from k group by series),
             f as (select g.series, g.date, price, row_number() over (partition by g.series order by g.date) as pos
                   from g left join k on g.series = k.series and g.date = k.date),
             n as (select *, {_neighbours('price', 'partition by series ')} from f)
        select series, date, {_filled('price').replace(', 6) as', ', 8) as')} from n""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("price"),
    )
    return rounded(win.interpolate_monthly(rows, "date", ["price"], ["series"], "D"), "price", places=8)
