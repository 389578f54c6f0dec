"""Views that shape the star-schema tables like election, survey and ballot data.

One SQL text serves both engines; ``{name}`` stands for another view or base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Result rows; a candidate is unique per race and one party is null on purpose.
    "elections": """
        select year(o_orderdate) as year, n_name as state, c_mktsegment as district,
               'PRESIDENT' as office, o_orderpriority as candidate,
               case o_orderpriority when '1-URGENT' then 'DEMOCRAT' when '2-HIGH' then 'REPUBLICAN'
                    when '3-MEDIUM' then 'LIBERTARIAN' when '5-LOW' then 'GREEN' end as party,
               count(*) as votes,
               cast(sum(count(*)) over (partition by year(o_orderdate), n_name, c_mktsegment) as bigint) as total_votes
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
        group by year(o_orderdate), n_name, c_mktsegment, o_orderpriority""",
    # House files: even years, DC, zero votes, lone candidates (NATION_3 has a district per
    # candidate), totals above the votes.
    "house": """
        select cast(1976 + 2 * (year - 1995) as int) as year, state,
               case when state = 'NATION_7' then 'DC' else substr(state, 8, 2) end as state_po,
               case when state = 'NATION_3' then concat(district, ' ', substr(candidate, 1, 1)) else district end as district,
               case when district = 'MACHINERY' then 'GENERAL' else 'GEN' end as stage,
               'FALSE' as runoff, 'FALSE' as special, candidate, party, false as writein, 'TOTAL' as mode,
               cast(case when votes % 4 = 0 then 0 else votes end as double) as candidatevotes,
               cast(total_votes + total_votes % 3 as double) as totalvotes
        from {elections}""",
    "president": """
        select cast(1976 + 4 * (year - 1995) as int) as year, state,
               case when state = 'NATION_7' then 'DC' else substr(state, 8, 2) end as state_po,
               candidate, max(party) as party, cast(sum(votes) as double) as candidatevotes,
               cast(sum(sum(votes)) over (partition by year, state) as double) as totalvotes
        from {elections} group by year, state, candidate""",
    "senate_rows": """
        select *, cast(floor((year - 1976) / 2) % 3 as int) + 1 as year_class from (
            select cast(1976 + 2 * (year(o_orderdate) - 1995) as int) as year, cast(n_nationkey as int) as nk,
                   n_name as state, o_orderpriority as candidate,
                   case o_orderpriority when '1-URGENT' then 'DEMOCRAT' when '2-HIGH' then 'REPUBLICAN'
                        when '3-MEDIUM' then 'LIBERTARIAN' else 'OTHER' end as party_simplified,
                   count(*) as candidatevotes
            from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
            group by year(o_orderdate), n_nationkey, n_name, o_orderpriority) c""",
    # Senate rows in 2-year steps: the class of the year in every state, and for some states in
    # some years a special election of another class as extra rows.
    "senate": """
        select year, state, case when state = 'NATION_7' then 'DC' else substr(state, 8, 2) end as state_po,
               'statewide' as district, class, class <> year_class as special, candidate, party_simplified,
               candidatevotes, cast(sum(candidatevotes) over (partition by year, state, class) as bigint) as totalvotes
        from (select *, year_class as class from {senate_rows}
              union all
              select *, nk % 3 + 1 as class from {senate_rows}
              where nk % 5 = 0 and year % 4 = 2 and nk % 3 + 1 <> year_class) f""",
    # Monthly shares.
    "survey": """
        select cast(date_trunc('month', o_orderdate) as date) as date,
               100e0 * sum(case when o_orderpriority = '2-HIGH' then 1 else 0 end) / count(*) as republicans,
               100e0 * sum(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end) / count(*) as independents,
               100e0 * sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) / count(*) as democrats
        from {orders} group by cast(date_trunc('month', o_orderdate) as date)""",
    # The same with blank values in some months.
    "gappy_survey": """
        select date, case when month(date) in (5, 6, 10) then null else republicans end as republicans,
               case when month(date) in (5, 6, 10) then null else independents end as independents,
               case when month(date) in (5, 6, 10) then null else democrats end as democrats from {survey}""",
    # New-format files: text votes with a bad value, a missing seat, lower-case stage.
    "new_format": """
        select o_orderkey as race_id, n_name as state, substr(n_name, 8, 2) as state_abbrev,
               case when o_orderkey % 7 = 0 then 'At large'
                    when o_orderkey % 5 = 0 then concat('Class ', cast(o_orderkey % 3 + 1 as varchar(10)))
                    else concat('District ', cast(o_orderkey % 20 as varchar(10))) end as office_seat_name,
               year(o_orderdate) as cycle, 'general' as stage, o_orderkey % 11 = 0 as special,
               c_name as candidate_name,
               case when o_orderkey % 13 = 0 then 'W' when o_orderkey % 17 = 0 then null
                    else o_orderpriority end as ballot_party,
               case when o_orderkey % 19 = 0 then 'n/a' else cast(o_orderkey % 1000 as varchar(10)) end as votes
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey""",
    # Old-format files without writein, mode, class and district.
    "old_format": """
        select year(o_orderdate) as year, n_name as state, substr(n_name, 8, 2) as state_po, 'GEN' as stage,
               o_orderkey % 11 = 0 as special, c_name as candidate,
               case when o_orderkey % 17 = 0 then null else lower(o_orderpriority) end as party,
               case when o_orderkey % 19 = 0 then 'n/a' else cast(o_orderkey % 1000 as varchar(10)) end as candidatevotes,
               o_orderkey % 1000 as totalvotes
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey""",
    # Two overlapping generations of one table: some customers changed their count.
    "old_results": """
        select year(o_orderdate) as year, n_name as state, o_orderpriority as candidate, c_mktsegment as party,
               c_name as district, o_orderkey as seq, o_totalprice as candidatevotes
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
        where year(o_orderdate) <= 1999""",
    "new_results": """
        select year(o_orderdate) as year, n_name as state, o_orderpriority as candidate, c_mktsegment as party,
               c_name as district, o_orderkey as seq, o_totalprice + 1 as candidatevotes
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
        where year(o_orderdate) >= 1999""",
    "shares": """
        select year, state, party, votes / cast(total_votes as double) * 100 as vote_share from {elections}""",
    "customers": """
        select c_custkey, c_mktsegment as segment, n_name as nation, c_acctbal as balance,
               case when c_custkey % 9 = 0 then null else c_acctbal end as gappy_balance,
               case when c_custkey % 7 = 0 then null else n_name end as gappy_nation
        from {customer} join {nation} on c_nationkey = n_nationkey""",
}

# Arrays are built differently in the two engines.
SPARK_ONLY = {
    "ballots": """
        select vec_id as voter_id, label as race, transform(embedding, x -> cast(x as double)) as scores
        from {embeddings}""",
    "points": "select vec_id as id, transform(embedding, x -> cast(x as double)) as x from {embeddings}",
    # Modes of the points as a mixture: more than a hundred means.
    "modes": """
        select mode_id, transform(array_sort(collect_list(struct(i, v))), s -> s.v) as center, max(n) as n
        from (select mode_id, i, avg(v) as v, count(*) as n
              from (select cast(label * 20 + vec_id % 20 as int) as mode_id,
                           posexplode(transform(embedding, x -> cast(x as double))) as (i, v) from {embeddings}) e
              group by mode_id, i) m group by mode_id""",
}
DUCKDB_ONLY = {
    "ballots": """
        select vec_id as voter_id, label as race, cast(embedding as double[]) as scores from {embeddings}""",
    "points": "select vec_id as id, cast(embedding as double[]) as x from {embeddings}",
    "mode_long": """
        select cast(label * 20 + vec_id % 20 as int) as mode_id, i, avg(cast(embedding[i] as double)) as c, count(*) as n
        from (select *, unnest(range(1, len(embedding) + 1)) as i from {embeddings}) e group by all""",
    "modes": """
        select mode_id, list(c order by i) as center, max(n) as n from {mode_long} group by mode_id""",
    # One row per ballot and option.
    "ballot_long": """
        select voter_id, race, cast(i - 1 as int) as option, scores[i] as score, len(scores) as width
        from (select *, unnest(range(1, len(scores) + 1)) as i from {ballots}) b""",
    "ballot_ranks": """
        select voter_id, race, option, score, width,
               cast(row_number() over (partition by voter_id order by score desc, option) as int) as rank
        from {ballot_long}""",
    "point_long": """
        select id, cast(i - 1 as int) as dim, x[i] as v from (select *, unnest(range(1, len(x) + 1)) as i from {points}) p""",
}


class Tables:
    """Fixture views of one test-data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            text = SPARK_ONLY.get(name) or VIEWS.get(name)
            if text is None:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                used = set(re.findall(r"\{(\w+)\}", text))
                self._built[name] = self.spark.sql(text, **{u: getattr(self, u) for u in used})
        return self._built[name]


def duckdb_with(views: list[str], body: str) -> str:
    """``body`` with the fixture views it needs as common table expressions."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        text = DUCKDB_ONLY.get(name) or VIEWS.get(name)
        if text is None or name in parts:
            return
        for used in re.findall(r"\{(\w+)\}", text):
            add(used)
        parts[name] = re.sub(r"\{(\w+)\}", r"\1", text).strip()

    for view in views:
        add(view)
    body = body.strip()
    ctes = [f"{name} as (\n{text})" for name, text in parts.items()]
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[len("with recursive ") :]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
