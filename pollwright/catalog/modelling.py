"""Queries on encoders, scaling and densities."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pollwright.catalog.registry import query, rounded
from pollwright.operators import density, features

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CODE = "dense_rank() over (order by coalesce(gappy_nation, 'Unknown')) - 1"


@query(
    "label_encode",
    ["customers"],
    f"select c_custkey, gappy_nation, cast({_CODE} as bigint) as gappy_nation_code from customers",
)
def _(t):
    rows = t.customers.select("c_custkey", "gappy_nation")
    return features.label_encode(rows, features.fit_labels(rows, ["gappy_nation"]), ["gappy_nation"])


_HOT = ", ".join(f"cast(segment = '{s}' as int) as {s.lower()}" for s in _SEGMENTS)


def _lower_hot(df):
    return df.withColumnsRenamed({f"segment_{s}": s.lower() for s in _SEGMENTS})


@query("one_hot", ["customers"], f"select c_custkey, {_HOT} from customers")
def _(t):
    rows = t.customers.select("c_custkey", "segment")
    return _lower_hot(features.one_hot(rows, {"segment": _SEGMENTS})).drop("segment")


@query(
    "one_hot_long",
    ["customers"],
    """select c_custkey, 'segment' as "column", segment as value from customers
       union all select c_custkey, 'gappy_nation', coalesce(gappy_nation, 'Unknown') from customers""",
)
def _(t):
    return features.one_hot_long(t.customers, "c_custkey", ["segment", "gappy_nation"])


@query(
    "category_values",
    ["customers"],
    """select distinct 'segment' as "column", segment as value from customers
       union all select distinct 'gappy_nation', coalesce(gappy_nation, 'Unknown') from customers""",
)
def _(t):
    return features.category_values(t.customers, ["segment", "gappy_nation"])


_SCALED = """round((coalesce(gappy_balance, 0) - avg(coalesce(gappy_balance, 0)) over ())
             / stddev_pop(coalesce(gappy_balance, 0)) over (), 6)"""


@query("standard_scale", ["customers"], f"select c_custkey, {_SCALED} as gappy_balance from customers")
def _(t):
    rows = t.customers.select("c_custkey", "gappy_balance")
    return rounded(features.standard_scale(rows, ["gappy_balance"]), "gappy_balance")


@query(
    "encode_demographics",
    ["customers"],
    f"""select c_custkey, cast({_CODE} as bigint) as gappy_nation_code, {_HOT}, {_SCALED} as gappy_balance
        from customers""",
)
def _(t):
    coded = features.encode_demographics(
        t.customers, ["gappy_nation"], ["gappy_balance"], {"segment": _SEGMENTS}, keep=["c_custkey"]
    )
    return rounded(_lower_hot(coded), "gappy_balance")


@query(
    "encode_party",
    ["elections"],
    """select year, state, district, candidate, case when party = 'DEMOCRAT' then 1 else 0 end as party_democrat,
              case when party = 'REPUBLICAN' then 1 else 0 end as party_republican, 0 as party_independent,
              case when party in ('LIBERTARIAN', 'GREEN') or party is null then 1 else 0 end as party_other
       from elections""",
)
def _(t):
    rows = features.encode_party(t.elections.select("year", "state", "district", "candidate", "party")).drop("party")
    return rows.withColumnsRenamed({f"party_{p}": f"party_{p.lower()}" for p in features.PARTY_ORDER})


_CLAMPED = [f"greatest({c}, 0)" for c in ("republicans", "independents", "democrats")]


@query(
    "normalize_shares",
    ["survey"],
    f"""select date, round(coalesce(republicans / nullif(s, 0), 0), 6) as republicans,
               round(coalesce(independents / nullif(s, 0), 0), 6) as independents,
               round(coalesce(democrats / nullif(s, 0), 0), 6) as democrats from (select *, {' + '.join(_CLAMPED)} as s from survey) v""",
)
def _(t):
    columns = ["republicans", "independents", "democrats"]
    return rounded(features.normalize_shares(t.survey, columns), *columns)


@query(
    "temporal_features",
    ["orders"],
    f"""select o_orderkey, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
               cast(dayofyear(o_orderdate) as int) as day_of_year,
               round(sin({2 * math.pi!r} * dayofyear(o_orderdate) / 365), 6) as sin_day,
               round(cos({2 * math.pi!r} * dayofyear(o_orderdate) / 365), 6) as cos_day from orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return rounded(features.temporal_features(rows).drop("date"), "sin_day", "cos_day")


# --- densities --------------------------------------------------------------------------

SCALE = 0.5

# A listed mixture of more than 64 modes, by a rule that both engines know.
LISTED = [([((k * 7 + d * 3) % 11 - 5) / 10 for d in range(64)], (k + 1) / 3240, 0.4 + k % 4 * 0.1) for k in range(80)]
_LISTED = """listed as (select k as mode_id, (k + 1) / 3240e0 as weight, 0.4e0 + k % 4 * 0.1e0 as scale,
                    list_transform(range(64), lambda d: ((k * 7 + d * 3) % 11 - 5) / 10e0) as center from range(80) as r(k))"""


def modes_of(t):
    """The fixture modes as a mixture: weights by size, one scale."""
    total = t.modes.agg(F.sum("n")).scalar()
    return t.modes.select("mode_id", "center", (F.col("n") / total).alias("weight"), F.lit(SCALE).alias("scale"))


def _log_density(source: str) -> str:
    return f"""terms as (
        select id, ln(weight) - len(x) * (ln(scale) + {math.log(2 * math.pi) / 2!r})
               - list_sum(list_transform(list_zip(x, center), lambda p: (p[1] - p[2]) ** 2)) / (2 * scale * scale) as term
        from points, {source}),
    tops as (select *, max(term) over (partition by id) as top from terms),
    scored as (select id, max(top) + ln(sum(exp(term - top))) as log_density from tops group by id)"""


_NORMAL = f"-0.5e0 * list_sum(list_transform(x, lambda v: v * v + {math.log(2 * math.pi)!r}))"


@query(
    "mixture_log_density",
    ["points"],
    f"with {_LISTED}, {_log_density('listed')} select id, round(log_density, 4) as log_density from scored",
)
def _(t):
    return rounded(density.mixture_log_density(t.points, LISTED), "log_density", places=4)


@query(
    "mixture_log_density_by_table",
    ["points", "modes"],
    f"""with fitted as (select mode_id, center, n / (select sum(n) from modes) as weight, {SCALE}e0 as scale from modes),
        {_log_density("fitted")} select id, round(log_density, 4) as log_density from scored""",
)
def _(t):
    return rounded(density.mixture_log_density_by_table(t.points, modes_of(t)), "log_density", places=4)


@query(
    "standard_normal_log_density",
    ["points"],
    f"select id, round({_NORMAL}, 6) as log_density from points",
)
def _(t):
    return rounded(density.standard_normal_log_density(t.points), "log_density")


@query(
    "nll_summary",
    ["points"],
    f"""with {_LISTED}, {_log_density("listed")}, normal as (select avg({_NORMAL}) as m from points),
             target as (select avg(log_density) as t from scored)
        select round(-m, 4) as nll, round(-t, 4) as target_nll, round(t - m, 4) as nll_gap from normal, target""",
)
def _(t):
    scored = density.score_both(t.points, LISTED)
    return rounded(density.nll_summary(scored), "nll", "target_nll", "nll_gap", places=4)


@query(
    "dimension_stats",
    ["point_long"],
    "select dim, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from point_long group by dim",
)
def _(t):
    return rounded(density.dimension_stats(t.points), "mean", "std")


@query(
    "marginal_histogram",
    ["point_long"],
    """with r as (select dim, min(v) as low, (max(v) - min(v)) / 50 as width, count(*) as total
                  from point_long group by dim),
            c as (select dim, least(floor((v - low) / width), 49)::int as bin, count(*) as n
                  from point_long join r using (dim) group by all)
       select dim, b::int as bin, round(low + b * width, 6) as edge_low, round(low + (b + 1) * width, 6) as edge_high,
              coalesce(n, 0) as n, round(coalesce(n, 0) / (total * width), 6) as density
       from r cross join range(50) as g(b) left join c on c.dim = r.dim and c.bin = g.b""".replace(
        "select dim, b::int", "select r.dim, b::int"
    ),
)
def _(t):
    return rounded(density.marginal_histogram(t.points), "edge_low", "edge_high", "density")


@query(
    "marginal_grid",
    ["point_long"],
    """with c as (select id, dim, floor((v + 1.5e0) / (2 * 1.5e0 / 30))::int as cell from point_long)
       select a.dim as dim_a, b.dim as dim_b, a.cell as cell_a, b.cell as cell_b, count(*) as n
       from c a join c b on a.id = b.id and a.dim < b.dim group by all""",
)
def _(t):
    return density.marginal_grid(t.points)
