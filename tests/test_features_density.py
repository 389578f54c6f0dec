from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollwright.functions import scale
from pollwright.operators import density, features


def test_labels_and_unseen_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    labels = features.fit_labels(df, ["c"])
    codes = sorted((r["c"] or "", r["c_code"]) for r in features.label_encode(df, labels, ["c"]).collect())
    assert codes == [("", 0), ("a", 1), ("b", 2), ("b", 2)]  # 'Unknown' sorts before lower case
    with pytest.raises(Exception, match="unseen value in c: z"):
        features.label_encode(spark.createDataFrame([("z",)], "c string"), labels, ["c"]).collect()


def test_one_hot_unseen_is_zero(spark):
    known = features.category_values(spark.createDataFrame([("a",), (None,)], "c string"), ["c"])
    values = sorted(r["value"] for r in known.collect())
    row = features.one_hot(spark.createDataFrame([("z",)], "c string"), {"c": values}).first()
    assert row.asDict() == {"c": "z", "c_Unknown": 0, "c_a": 0}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (5.0, 5.0)], "x double, k double")
    rows = features.standard_scale(df, ["x", "k"]).collect()
    x = np.array([1.0, 0.0, 5.0])
    assert [r["x"] for r in rows] == pytest.approx(list((x - x.mean()) / x.std()))
    assert [r["k"] for r in rows] == [0.0, 0.0, 0.0]


def test_encoder_applies_what_it_fitted(spark):
    train = spark.createDataFrame([("a", "u", 0.0), ("b", "v", 2.0)], "c string, h string, x double")
    encoder = features.DemographicEncoder(["c"], ["x"], {"h": ["u", "v"]}).fit(train)
    assert encoder.feature_names == ["c_code", "h_u", "h_v", "x"]
    row = encoder.transform(spark.createDataFrame([("b", "w", 3.0)], "c string, h string, x double")).first()
    assert tuple(row) == (1, 0, 0, 2.0)


def test_party_columns(spark):
    df = spark.createDataFrame([("democrat",), ("GREEN",), (None,), ("Independent",), ("WHIG",)], "party string")
    rows = [tuple(r)[1:] for r in features.encode_party(df).collect()]
    assert rows == [(1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 1, 0), (0, 0, 0, 0)]


def test_share_rows(spark):
    df = spark.createDataFrame([(1.0, 3.0), (-2.0, 4.0), (0.0, -1.0)], "a double, b double")
    assert [tuple(r) for r in features.normalize_shares(df, ["a", "b"]).collect()] == [(0.25, 0.75), (0.0, 1.0), (0.0, 0.0)]


def test_date_features(spark):
    row = features.temporal_features(spark.createDataFrame([(datetime.date(2020, 12, 31),)], "date date")).first()
    assert (row["year"], row["month"], row["day_of_year"]) == (2020, 12, 366)
    assert row["sin_day"] == pytest.approx(math.sin(2 * math.pi * 366 / 365))


def expected(x, modes):
    if x is None or len(x) != 3:
        return None
    terms = [
        math.log(w) - 3 * math.log(s) - 1.5 * math.log(2 * math.pi) - np.sum((np.array(x) - np.array(c)) ** 2) / (2 * s * s)
        for c, w, s in modes
        if w > 0
    ]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


@pytest.mark.parametrize("k", [1, 64, 65, 600])
def test_mixture_listed_and_in_a_table(spark, k):
    """One row out per row in, at every number of modes: equal and null ids, odd widths, null."""
    rng = np.random.default_rng(5)
    modes = [(c.tolist(), 0.0 if i == 3 else float(w), 0.3 + i / 600) for i, (c, w) in enumerate(zip(rng.normal(size=(k, 3)), rng.random(k)))]
    rows = [(int(i) % 30 if i % 7 else None, (rng.normal(size=3) * 3).tolist()) for i in range(50)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (2, [1.0, 2.0, 3.0, 4.0]), (2, None), (None, [0.5])]
    points = spark.createDataFrame(rows, "id int, x array<double>")
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(modes)], "mode_id int, center array<double>, weight double, scale double")
    order = lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])
    want = sorted(((i, expected(x, modes)) for i, x in rows), key=order)
    for scored in (density.mixture_log_density(points, modes), density.mixture_log_density_by_table(points, table)):
        got = sorted(map(tuple, scored.collect()), key=order)
        assert [g[0] for g in got] == [w[0] for w in want]
        for (_, g), (_, w) in zip(got, want):
            assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, abs=1e-9))
    both = density.score_both(points, modes).agg(F.count("*"), F.avg("target_log_density")).first()
    assert both[0] == len(rows) and both[1] == pytest.approx(np.mean([w for _, w in want if w is not None]))


def test_marginals(spark):
    xs = np.random.default_rng(2).normal(size=(400, 3))
    points = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(xs)], "id int, x array<double>")
    rows = density.marginal_histogram(points, bins=10).collect()
    for d in range(3):
        counts, edges = np.histogram(xs[:, d], bins=10)
        mine = sorted((r for r in rows if r["dim"] == d), key=lambda r: r["bin"])
        assert [r["n"] for r in mine] == list(counts)
        assert [r["edge_low"] for r in mine] == pytest.approx(list(edges[:-1]))
        assert sum(r["density"] * (r["edge_high"] - r["edge_low"]) for r in mine) == pytest.approx(1.0)
    grid = density.marginal_grid(points, grid=6, lim=1.5).collect()
    assert {(r["dim_a"], r["dim_b"]) for r in grid} == {(0, 1), (0, 2), (1, 2)}
    assert sum(r["n"] for r in grid) == 3 * 400
    stats = {r["dim"]: (r["mean"], r["std"]) for r in density.dimension_stats(points).collect()}
    assert stats[1] == pytest.approx((xs[:, 1].mean(), xs[:, 1].std()))
    normal = density.standard_normal_log_density(points).where("id = 0").first()["log_density"]
    assert normal == pytest.approx(float(-0.5 * np.sum(xs[0] ** 2 + math.log(2 * math.pi))))


def test_pruned_density_is_the_full_sum(spark):
    """Clusters of modes, near and far, of several scales and widths, against the plain sum."""
    rng = random.Random(5)
    modes = [([c + rng.gauss(0, 0.2) for _ in range(6)], rng.random(), rng.choice([0.05, 0.5, 2.0])) for c in range(-40, 40) for _ in range(3)]
    modes += [([1.0, 2.0], 0.7, 0.3), ([0.0] * 6, 0.0, 1.0)]
    points = [[rng.uniform(-45, 45)] * 6 for _ in range(150)] + [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(50)]
    points += [[1.5, 2.5], [1e6] * 6, modes[7][0], [1.0], None]

    def full(x):
        terms = [
            math.log(w) - len(c) * (math.log(s) + math.log(2 * math.pi) / 2) - sum((a - b) ** 2 for a, b in zip(x, c)) / (2 * s * s)
            for c, w, s in modes
            if w > 0 and x is not None and len(c) == len(x)
        ]
        return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)) if terms else None

    df = spark.createDataFrame(list(enumerate(points)), "id bigint, x array<double>")
    got = {r["id"]: r["log_density"] for r in density.mixture_log_density(df, modes).collect()}
    assert len(got) == len(points)
    for i, x in enumerate(points):
        assert got[i] is None if full(x) is None else got[i] == pytest.approx(full(x), rel=1e-9, abs=1e-9)


def test_copies_of_a_row_come_from_many_tasks(spark):
    one = spark.createDataFrame([(1, 500_000), (2, 3), (None, 2)], "id bigint, n bigint")
    many = scale.repeat_rows(one, "n", "id")
    rows = many.groupBy(F.spark_partition_id().alias("p"), "id").count().collect()
    assert sum(r["count"] for r in rows if r["id"] == 1) == 500_000 and len({r["p"] for r in rows if r["id"] == 1}) > 2
    assert sum(r["count"] for r in rows if r["id"] is None) == 2
