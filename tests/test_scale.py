"""What the plans look like, and how they behave when one key holds much of the data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pollwright.catalog.fixtures import Tables
from pollwright.functions.scale import null_safe_join, running_sum, with_group_stats
from pollwright.operators import aggregates as agg
from pollwright.operators import ballots as bal
from pollwright.operators import features, joins, lottery
from pollwright.operators import results as res
from pollwright.operators import windows as win
from pollwright.plans import control
from pollwright.session import scratch_dir

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which a test-sized hot key counts as skewed; broadcasts off."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture
def hot(spark):
    """A third of 150,000 rows in one race, the rest spread over 1,000."""
    race = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).cast("int")
    return spark.range(0, 150_000, 1, 8).select(
        race.alias("race"),
        F.concat(F.lit("candidate "), F.col("id").cast("string")).alias("candidate"),
        (F.col("id") % 11).cast("double").alias("candidatevotes"),
        F.lit(500_000.0).alias("totalvotes"),
    )


def test_group_stats_split_a_hot_key(hot, small_partitions):
    df = win.count_winner(hot, ["race"])
    text = final_plan(df)
    assert "skew=true" in text
    assert "Window" not in text
    assert df.count() == 150_000
    assert df.where("count_win = 1 and candidatevotes <> 10").count() == 0


def test_hot_race_in_the_lottery(hot, small_partitions):
    slices = lottery.vote_slices(hot, ["race"], ["candidate"])
    wins = lottery.draw_winners(slices.withColumn("race_total", F.col("race_votes")), ["race"], n=8)
    per_race = wins.groupBy("race", "replicate").agg(F.sum("won").alias("w"))
    assert per_race.agg(F.min("w"), F.max("w")).first()[:] == (1, 1)
    per_task = slices.where("race = -1").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 4 and max(r["count"] for r in per_task) < 50_000 / 2


def test_hot_category_in_label_codes(spark, small_partitions):
    word = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), (F.col("id") % 500).cast("string")))
    df = spark.range(0, 90_000, 1, 8).select("id", word.alias("c"))
    coded = features.label_encode(df, features.fit_labels(df, ["c"]), ["c"])
    assert "skew=true" in final_plan(coded)
    codes = coded.groupBy("c").agg(F.min("c_code").alias("a"), F.max("c_code").alias("b")).orderBy("c").collect()
    assert [(r["a"], r["b"]) for r in codes] == [(i, i) for i in range(len(codes))]
    assert coded.count() == 90_000


def test_hot_group_in_running_sum(hot, small_partitions):
    df = running_sum(hot, ["race"], ["candidate"], F.lit(1), "place").where("race = -1")
    assert df.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (1, 50_000, 50_000)


def test_hot_race_in_instant_runoff(spark, small_partitions):
    scores = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double") for i in range(4)])
    race = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).cast("int")
    df = spark.range(9_000).select(F.col("id").alias("voter_id"), race.alias("race"), scores.alias("scores"))
    many = {r["race"]: tuple(r) for r in bal.instant_runoff(df, ["race"]).collect()}
    alone = bal.instant_runoff(df.where("race = -1"), ["race"]).first()
    assert len(many) == 51 and many[-1] == tuple(alone)


def test_merge_limits_copies_before_the_shuffle(tables):
    text = plan(win.merge_keep_latest(tables.old_results, tables.new_results, "president", sequence=["seq"]))
    before_shuffle = text[text.rindex("WindowGroupLimit"):]
    assert text.count("WindowGroupLimit") == 2 and "Partial" in before_shuffle
    assert text.index("Final") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_merge_of_many_copies(spark):
    rows = spark.range(100_000).select(
        F.lit(2000).alias("year"), F.lit("X").alias("state"), F.lit("a").alias("candidate"), F.lit("P").alias("party"),
        F.col("id").alias("seq"), F.lit(1.0).alias("candidatevotes"),
    )
    (row,) = win.merge_keep_latest(rows, rows.limit(0), "president", sequence=["seq"]).collect()
    assert row["seq"] == 99_999


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_custkey").alias("year"), F.col("o_orderstatus").alias("state"), "o_totalprice", "o_orderpriority"
    )
    text = plan(res.filter_in(orders, years=[5, 7]).select("state"))
    assert "In(o_custkey, [5,7])" in text and "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in text


def test_no_python_and_no_cross_join_in_any_plan(tables):
    house, senate = tables.house, tables.senate
    frames = [
        control.house_control(house, 8),
        control.senate_control(senate, 8),
        control.elector_lottery(tables.president, house, 4),
        joins.align_nearest(tables.survey, tables.elections),
        win.interpolate_monthly(tables.survey, "date", ["democrats"]),
        bal.condorcet(tables.ballots, ["race"]),
        bal.method_results(tables.ballots, ["race"]),
        features.standard_scale(tables.customers, ["balance"]),
        agg.seat_histogram(control.house_control(house, 4), 10, "year", "party_major"),
    ]
    for df in frames:
        text = plan(df)
        for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, bad


def test_replicates_are_not_shuffled_before_they_are_added(tables):
    text = plan(control.house_control(tables.house, 200))
    above = text[: text.index("Generate explode")]
    assert above.count("Exchange hashpartitioning") == 1 and "partial_sum(won" in above


def test_lottery_computes_its_tickets_once(spark, tmp_path):
    control_rows = Tables(spark, SF).house
    control_rows.write.parquet(str(tmp_path / "house"))
    text = final_plan(control.house_control(spark.read.parquet(str(tmp_path / "house")), 8))
    assert "ReusedExchange" in text


@pytest.mark.parametrize("office", ["house", "senate"])
def test_control_reads_its_input_once(spark, tmp_path, office):
    getattr(Tables(spark, SF), office).write.parquet(str(tmp_path / office))
    rows = spark.read.parquet(str(tmp_path / office))
    run = control.house_control if office == "house" else control.senate_control
    # The Senate goes on from a checkpoint of its slices.
    assert final_plan(run(rows, 8)).count("FileScan") == (1 if office == "house" else 0)


def test_superseded_terms_are_an_equi_anti_join(tables):
    rows = res.senate_class_columns(tables.senate)
    regular, special = res.split_special(rows)
    text = plan(joins.drop_superseded(joins.carry_forward(regular), special))
    assert "LeftAnti" in text and "NestedLoop" not in text


def test_nearest_survey_window_sees_dates_only(spark, tables, tmp_path):
    tables.survey.write.parquet(str(tmp_path / "survey"))
    tables.elections.write.parquet(str(tmp_path / "elections"))
    survey, elections = (spark.read.parquet(str(tmp_path / n)) for n in ("survey", "elections"))
    text = plan(joins.align_nearest(survey, elections))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("SinglePartition") == 1
    assert "candidate" not in text[text.index("SinglePartition"):]


def test_no_frame_is_read_anew_for_every_row(spark):
    days = spark.range(9).select(F.date_add(F.lit("2000-01-31"), F.col("id").cast("int") * 40).alias("date"), "id")
    years = spark.range(2000, 2003).select(F.col("id").cast("int").alias("year"))
    for df in (joins.align_nearest(days, years), win.interpolate_monthly(days, "date", ["id"])):
        assert "unboundedfollowing" not in plan(df).lower()
        assert df.count() > 0


def test_survey_times_count_by_day(spark):
    """A timestamp column gives one row per day to the window, not one per instant."""
    surveys = spark.createDataFrame([("2000-10-30 08:00:00", 1.0), ("2000-10-30 20:00:00", 2.0)], "date string, x double")
    surveys = surveys.withColumn("date", F.col("date").cast("timestamp"))
    (row,) = joins.align_nearest(surveys, spark.createDataFrame([(2000,)], "year int")).collect()
    assert (str(row["survey_date"]), row["x"]) == ("2000-10-30", 1.0)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, w int")
    assert [tuple(r) for r in null_safe_join(left, right, ["k"]).collect()] == [(None, 1, 10)]
    assert with_group_stats(left, ["k"], n=F.count("*")).count() == 2


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == (named.rstrip("/") if named else scratch_dir(spark))
    assert named or os.path.isdir(scratch_dir(spark))
