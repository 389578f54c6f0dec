"""Queries through files: the tables are written in a file format and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pollwright.catalog.registry import query, rounded
from pollwright.session import scratch_path
from pollwright.sources import compass, elections, sinks, surveys

_SHARES = ["republicans", "independents", "democrats"]
_LEANERS = {"Republicans/Republican leaners": "republicans", "Democrats/Democratic leaners": "democrats"}


def _poll_file(t, titles: dict[str, str]) -> str:
    """The survey view as a poll CSV: period text, party titles and a row of units."""
    polls = t.survey.select(
        F.date_format("date", "yyyy MMM d-20").alias("X.1"),
        *[F.col(v).cast("string").alias(title) for title, v in titles.items()],
    )
    units = t.survey.select(
        F.lit(None).cast("string").alias("X.1"), *[F.lit("%").alias(title) for title in titles]
    ).limit(1)
    path = scratch_path(t.spark, "polls")
    units.unionByName(polls).write.option("header", True).csv(path)
    return path


@query(
    "read_party_survey",
    ["survey"],
    """select date, round(republicans, 6) as republicans, round(independents, 6) as independents,
              round(democrats, 6) as democrats, 'polls' as source from survey""",
)
def _(t):
    path = _poll_file(t, surveys.PARTY_TITLES)
    return rounded(surveys.read_party_survey(t.spark, path, source="polls"), *_SHARES)


@query(
    "read_leaner_survey",
    ["survey"],
    """select date, round(republicans, 6) as republican_leaners, round(democrats, 6) as democratic_leaners,
              'polls' as source from survey""",
)
def _(t):
    path = _poll_file(t, _LEANERS)
    polls = surveys.read_leaner_survey(t.spark, path, source="polls")
    return rounded(polls, "republican_leaners", "democratic_leaners")


def _result_file(t, party: str) -> str:
    """The elections view as a published result CSV."""
    rows = t.elections.select(
        "year", "state", "office", "district", "candidate", F.col("party").alias(party),
        F.col("votes").alias("candidatevotes"), F.col("total_votes").alias("totalvotes"),
    )
    path = scratch_path(t.spark, "results")
    sinks.write_table(rows, path, "csv")
    return path


_D3 = "select year, state, office, candidate, party, votes, total_votes from elections"


@query("read_president", ["elections"], _D3)
def _(t):
    return elections.read_president(t.spark, _result_file(t, "party_simplified"))


@query("read_senate", ["elections"], _D3 + " where year in (1996, 2000) and state in ('NATION_1', 'NATION_2')")
def _(t):
    path = _result_file(t, "party_simplified")
    return elections.read_senate(t.spark, path, years=[1996, 2000], states=["NATION_1", "NATION_2"])


@query("read_house", ["elections"], _D3 + " where year = 1996 and district in ('BUILDING', 'MACHINERY')")
def _(t):
    path = _result_file(t, "party")
    return elections.read_house(t.spark, path, years="1996", districts=["BUILDING", "MACHINERY"])


@query("read_house_by_year", ["elections"], _D3 + " where year in (1995, 1997) and district in ('BUILDING', 'MACHINERY')")
def _(t):
    """As ``read_house`` from a Parquet folder per year, of which two are read."""
    rows = t.elections.withColumnsRenamed({"votes": "candidatevotes", "total_votes": "totalvotes"})
    path = scratch_path(t.spark, "results")
    sinks.write_table(rows, path, "parquet", partition_by=["year"])
    return elections.read_house(t.spark, path, [1995, 1997], districts="BUILDING,MACHINERY", format="parquet")


@query("write_table", ["elections"], "select year, state, district, candidate, party, votes from elections")
def _(t):
    path = scratch_path(t.spark, "table")
    rows = t.elections.select("year", "state", "district", "candidate", "party", "votes")
    sinks.write_table(rows, path, "parquet", partition_by=["year"])
    return t.spark.read.parquet(path)


@query(
    "export_bundle",
    ["elections", "senate", "survey"],
    """select 'surveys/party_identification' as dataset, cast(date as varchar) as key, 'republicans' as name,
              round(republicans, 6) as value from survey
       union all select 'surveys/party_identification', cast(date as varchar), 'independents', round(independents, 6) from survey
       union all select 'surveys/party_identification', cast(date as varchar), 'democrats', round(democrats, 6) from survey
       union all select 'surveys/leaners', cast(date as varchar), 'republican_leaners', round(republicans, 6) from survey
       union all select 'surveys/leaners', cast(date as varchar), 'democratic_leaners', round(democrats, 6) from survey
       union all select 'elections/presidential/by_year', cast(year as varchar), party, cast(sum(votes) as double)
                 from elections where party is not null group by all
       union all select 'elections/presidential/by_state', state, party, cast(sum(votes) as double)
                 from elections where party is not null group by all
       union all select 'elections/presidential/vote_shares', year || '/' || state, party,
                        round(votes / cast(total_votes as double) * 100, 6) from elections
       union all select 'elections/senate/by_year', cast(year as varchar), party_simplified, cast(sum(candidatevotes) as double)
                 from senate where party_simplified is not null group by all""",
)
def _(t):
    """All six datasets written by the exporter and read back."""
    polls = surveys.read_party_survey(t.spark, _poll_file(t, surveys.PARTY_TITLES))
    leaners = surveys.read_leaner_survey(t.spark, _poll_file(t, _LEANERS))
    senate = t.senate.withColumnsRenamed({"party_simplified": "party", "candidatevotes": "votes", "totalvotes": "total_votes"})
    path = scratch_path(t.spark, "bundle")
    bundle = sinks.visualization_bundle(polls, leaners, t.elections, senate)
    sinks.export_bundle(bundle, path)

    def rows(dataset: str, key, *pairs):
        schema = bundle[dataset].schema
        named = F.array(*[F.struct(n.alias("name"), v.cast("double").alias("value")) for n, v in pairs])
        back = t.spark.read.schema(schema).json(f"{path}/{dataset}")
        cells = back.select(F.lit(dataset).alias("dataset"), key.cast("string").alias("key"), F.explode(named).alias("c"))
        return cells.select("dataset", "key", "c.name", F.col("c.value").alias("value"))

    column = lambda *names: [(F.lit(n), F.col(n)) for n in names]
    votes = (F.col("party"), F.col("votes"))
    place = F.concat_ws("/", F.col("year").cast("string"), "state")
    parts = [
        rows("surveys/party_identification", F.col("date"), *column(*_SHARES)),
        rows("surveys/leaners", F.col("date"), *column("republican_leaners", "democratic_leaners")),
        rows("elections/presidential/by_year", F.col("year"), votes),
        rows("elections/presidential/by_state", F.col("state"), votes),
        rows("elections/presidential/vote_shares", place, (F.col("party"), F.col("vote_share"))),
        rows("elections/senate/by_year", F.col("year"), votes),
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), "value")


def _compass_file(t) -> str:
    """One compass document: a dimension per nation, a mode per label, both summed up from the tables."""
    modes = t.modes.groupBy().agg(
        F.count(F.lit(1)).cast("int").alias("n_modes"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("mode_id", F.col("center").alias("c")))),
            lambda m: m["c"],
        ).alias("mode_centers"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("mode_id", F.col("n").cast("double").alias("w")))), lambda m: m["w"]
        ).alias("mode_weights"),
        F.lit(0.15).alias("mode_scale"),
    )
    named = F.replace(F.lower(F.concat_ws("_", "r_name", "n_name")), F.lit(" "), F.lit("_"))
    per_nation = t.customer.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    dimensions = (
        per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(named.alias("name"), F.col("r_name").alias("description"), F.array("low", "high").alias("range"))
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("name", "description", "range"))).alias("dimensions"))
    )
    document = modes.select(
        F.struct(F.struct("*").alias("target_distribution")).alias("model_config"),
        dimensions.scalar().alias("dimensions"),
    )
    path = scratch_path(t.spark, "compass")
    document.select(F.struct("dimensions", "model_config").alias("political_compass")).write.json(path)
    return path


@query(
    "read_modes",
    ["mode_long"],
    """select cast(dense_rank() over (order by mode_id) - 1 as int) as mode_id, cast(i - 1 as int) as dim,
              round(c, 6) as c, round(n / (sum(case when i = 1 then n end) over ()), 6) as weight, 0.15e0 as scale
       from mode_long""",
)
def _(t):
    modes = compass.read_modes(t.spark, _compass_file(t))
    flat = modes.select("mode_id", F.posexplode("center").alias("dim", "c"), "weight", "scale")
    return rounded(flat, "c", "weight")


@query(
    "read_dimensions",
    [],
    """select name, description, low, high,
              array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') as label
       from (select replace(lower(r_name || '_' || n_name), ' ', '_') as name, r_name as description,
                    min(c_acctbal) as low, max(c_acctbal) as high
             from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
             group by r_name, n_name) d""",
)
def _(t):
    dims = compass.read_dimensions(t.spark, _compass_file(t))
    return dims.select(
        "name", "description", "label", F.col("range")[0].alias("low"), F.col("range")[1].alias("high")
    )
