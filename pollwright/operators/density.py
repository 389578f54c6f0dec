"""Mixture densities and marginals of a points table (``id``, ``x`` array)."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.functions.columns import bin_index, let, squared_distance
from pollwright.functions.scale import pair_with_blocks, repeat_rows

LOG_2PI = math.log(2.0 * math.pi)

Mode = tuple[Sequence[float], float, float]  # center, weight, scale


def _mode_terms(modes: Column, x: str) -> Column:
    """``log w + log N(x; center, scale^2 I)`` for an array of (center, weight, scale); modes
    without weight or of another width have none."""
    d = F.size(x)
    return F.transform(
        F.filter(modes, lambda m: (m["weight"] > 0) & (F.size(m["center"]) == d)),
        lambda m: F.ln(m["weight"])
        - d * (F.ln(m["scale"]) + LOG_2PI / 2)
        - squared_distance(F.col(x), m["center"]) / (F.lit(2.0) * m["scale"] * m["scale"]),
    )


def _max_and_sum(terms: Column) -> Column:
    """(top, sum of exp(term - top)): the pieces of a log-sum-exp that can be merged."""
    topped = let(terms, lambda ts: F.struct(ts.alias("ts"), F.array_max(ts).alias("top")))
    return let(
        topped,
        lambda p: F.struct(
            p["top"].alias("top"),
            F.aggregate(p["ts"], F.lit(0.0), lambda acc, t: acc + F.exp(t - p["top"])).alias("sum"),
        ),
    )


# A term this many nats below the largest one is lost in its rounding, also if there are millions.
NEGLIGIBLE = 56.0


def _blocks(modes: Sequence[Mode], width: int) -> list[dict]:
    """The modes of one width in about sqrt(n) balls: pivots far from each other, each mode with its
    nearest pivot. A ball has the largest term that a mode of it can have at its own center, and its
    largest scale, so that a point's distance to the pivot bounds all its terms."""
    fitting = [(list(map(float, c)), float(w), float(s)) for c, w, s in modes if w > 0 and len(c) == width]
    pivots = [fitting[0][0]]
    near = [(math.dist(c, pivots[0]), 0) for c, _, _ in fitting]
    while len(pivots) < math.isqrt(len(fitting) - 1) + 1:
        far = max(range(len(fitting)), key=lambda i: near[i][0])
        if near[far][0] == 0:
            break
        pivots.append(fitting[far][0])
        near = [min(old, (math.dist(c, pivots[-1]), len(pivots) - 1)) for old, (c, _, _) in zip(near, fitting)]
    out = []
    for number, pivot in enumerate(pivots):
        held = [m for m, (_, p) in zip(fitting, near) if p == number]
        terms = [
            {"center": c, "peak": math.log(w) - width * (math.log(s) + LOG_2PI / 2), "spread": 2.0 * s * s} for c, w, s in held
        ]
        out.append(
            {
                "pivot": pivot,
                "radius": max(d for d, p in near if p == number),
                "peak": max(t["peak"] for t in terms),
                "spread": max(t["spread"] for t in terms),
                "modes": terms,
            }
        )
    return out


_BALLS = (
    "array<struct<pivot:array<double>,radius:double,peak:double,spread:double,"
    "modes:array<struct<center:array<double>,peak:double,spread:double>>>>"
)


def _log_density(modes: Sequence[Mode], x: str) -> Column:
    """The log of the sum over all modes, balls by falling bound; a ball whose best possible term
    is negligible beside what was found is not opened."""
    result = F.lit(None).cast("double")
    for width in sorted({len(c) for c, w, _ in modes if w > 0}):
        # One literal, parsed once: thousands of them take seconds to build.
        balls = F.from_json(F.lit(json.dumps(_blocks(modes, width))), _BALLS)
        result = F.when(F.size(x) == width, _pruned_log_sum(balls, F.col(x))).otherwise(result)
    return result


def _pruned_log_sum(balls: Column, x: Column) -> Column:
    def bounded(b: Column) -> Column:
        gap = F.greatest(F.lit(0.0), F.sqrt(squared_distance(x, b["pivot"])) - b["radius"])
        # Sorted rising, so the bound's sign is turned; a null or NaN in the point has no bound.
        return F.struct((gap * gap / b["spread"] - b["peak"]).alias("under"), b["modes"].alias("modes"))

    def merged(a: Column, p: Column) -> Column:
        top = F.greatest(a["top"], p["top"])
        return let(
            top,
            lambda t: F.struct(
                t.alias("top"), (a["sum"] * F.exp(a["top"] - t) + p["sum"] * F.exp(p["top"] - t)).alias("sum")
            ),
        )

    def opened(modes: Column) -> Column:
        return _max_and_sum(F.transform(modes, lambda m: m["peak"] - squared_distance(x, m["center"]) / m["spread"]))

    def step(a: Column, b: Column) -> Column:
        return F.when(-b["under"] < a["top"] - NEGLIGIBLE, a).otherwise(let(opened(b["modes"]), lambda p: merged(a, p)))

    lowest = F.struct(F.lit(-sys.float_info.max).alias("top"), F.lit(0.0).alias("sum"))
    ordered = F.array_sort(F.transform(balls, bounded), lambda a, b: F.when(a["under"] < b["under"], -1).when(a["under"] > b["under"], 1).otherwise(0))
    return let(F.aggregate(ordered, lowest, step), lambda p: p["top"] + F.ln(p["sum"]))


def mixture_log_density(points: DataFrame, modes: Sequence[Mode], key: str = "id", x: str = "x") -> DataFrame:
    """(key, log_density) under a Gaussian mixture of listed spherical modes.

    One row out for each row in; a null point, or one of another width than all modes, has null.
    A row needs only itself and the modes, so nothing moves. Modes lie in balls, and a ball that
    can't add anything above double rounding to a point's sum is skipped.
    """
    return points.select(key, _log_density(modes, x).alias("log_density"))


def mixture_log_density_by_table(points: DataFrame, modes: DataFrame, key: str = "id", x: str = "x") -> DataFrame:
    """``mixture_log_density`` for a table (mode_id, center, weight, scale) that may be long, with
    the same contract.

    Equal (key, point) rows are counted and scored once. Each is met by every block of modes, the
    sum is built from one (max, sum) pair per block, and the row is repeated as often as it came.
    """
    counted = points.select(key, x).groupBy(key, x).agg(F.count(F.lit(1)).alias("_n"))
    slim = modes.select("mode_id", "center", "weight", "scale")
    met = pair_with_blocks(counted, slim, key="mode_id", spread=x)
    parts = met.select(key, x, "_n", _max_and_sum(_mode_terms(F.col("_options"), x)).alias("_p"))
    # One short list per point: as many entries as there are blocks.
    tops = parts.groupBy(key, x, "_n").agg(F.collect_list(F.when(F.col("_p.top").isNotNull(), F.col("_p"))).alias("_ps"))
    top = F.array_max(F.transform("_ps", lambda p: p["top"]))
    total = let(
        top, lambda t: t + F.ln(F.aggregate("_ps", F.lit(0.0), lambda acc, p: acc + p["sum"] * F.exp(p["top"] - t)))
    )
    return repeat_rows(tops.select(key, total.alias("log_density"), "_n"), "_n", key)


def standard_normal_log_density(points: DataFrame, key: str = "id", x: str = "x") -> DataFrame:
    """(key, log_density) under the standard normal."""
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v + LOG_2PI)
    return points.select(key, (F.lit(-0.5) * squares).alias("log_density"))


def nll_summary(scored: DataFrame, model: str = "model_log_density", target: str = "target_log_density") -> DataFrame:
    """One row: mean negative log density of both scores and their gap."""
    return scored.agg(
        F.avg(-F.col(model)).alias("nll"),
        F.avg(-F.col(target)).alias("target_nll"),
        (F.avg(-F.col(model)) - F.avg(-F.col(target))).alias("nll_gap"),
    )


def _long(points: DataFrame, x: str) -> DataFrame:
    return points.select(F.posexplode(x).alias("dim", "v"))


def dimension_stats(points: DataFrame, x: str = "x") -> DataFrame:
    """(dim, mean, std): population deviation."""
    return _long(points, x).groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def marginal_histogram(points: DataFrame, bins: int = 50, x: str = "x") -> DataFrame:
    """(dim, bin, edge_low, edge_high, n, density) of every dimension, empty bins included."""
    ranges = _long(points, x).groupBy("dim").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n_points")
    )
    flat = F.col("low") == F.col("high")
    ranges = ranges.select(
        "dim",
        "n_points",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / bins)
    # One row per dimension of a point, that is, the width of one array.
    placed = _long(points, x).join(F.broadcast(ranges), "dim")
    counted = placed.groupBy("dim", bin_index(F.col("v"), F.col("low"), F.col("width"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    empty = ranges.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("bigint").alias("n")
    )
    full = counted.unionByName(empty).groupBy("dim", "bin").agg(F.sum("n").alias("n"))
    return full.join(F.broadcast(ranges), "dim").select(
        "dim",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("edge_low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("edge_high"),
        "n",
        (F.col("n") / (F.col("n_points") * F.col("width"))).alias("density"),
    )


def marginal_grid(points: DataFrame, grid: int = 30, lim: float = 1.5, x: str = "x") -> DataFrame:
    """(dim_a, dim_b, cell_a, cell_b, n) for dimensions a < b; only cells that hold a point.

    The grid divides [-lim, lim]; cells go on beyond it, so no point is lost.
    """
    size = 2.0 * lim / grid
    cells = F.transform(x, lambda v: F.floor((v + lim) / size).cast("int"))
    first = points.select(cells.alias("_c")).select("_c", F.posexplode("_c").alias("dim_a", "cell_a"))
    rest = F.slice("_c", F.col("dim_a") + 2, F.size("_c"))
    pairs = first.select("dim_a", "cell_a", F.posexplode(rest).alias("_i", "cell_b"))
    return pairs.groupBy("dim_a", (F.col("dim_a") + 1 + F.col("_i")).alias("dim_b"), "cell_a", "cell_b").agg(
        F.count(F.lit(1)).alias("n")
    )


def score_both(points: DataFrame, modes: Sequence[Mode], key: str = "id", x: str = "x") -> DataFrame:
    """Both log densities of every point side by side, in one pass."""
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v + LOG_2PI)
    return points.select(
        key,
        (F.lit(-0.5) * squares).alias("model_log_density"),
        _log_density(modes, x).alias("target_log_density"),
    )
