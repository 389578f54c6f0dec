from __future__ import annotations

import datetime
import json
import re

import pytest

from pollwright.operators.standardize import import_election, is_new_format, standardize_by_mapping, validate
from pollwright.sources import compass, elections, mappings, sinks, surveys

PARTY = "﻿X.1,Republicans, Independents ,Democrats\n,%,%,%\n2024 Feb 1-20,28,42,30\n2004 Jan 29-Feb 1,31,,33\n2008 May 30-Jun1,26,36.5,37\n"


def test_party_survey(spark, tmp_path):
    (tmp_path / "party.csv").write_text(PARTY)
    rows = {r["date"]: r for r in surveys.read_party_survey(spark, str(tmp_path / "party.csv")).collect()}
    assert set(rows) == {datetime.date(2024, 2, 1), datetime.date(2004, 1, 1), datetime.date(2008, 5, 1)}
    assert rows[datetime.date(2004, 1, 1)]["independents"] is None
    assert rows[datetime.date(2008, 5, 1)]["independents"] == 36.5
    assert {r["source"] for r in rows.values()} == {"party.csv"}


def test_leaner_survey(spark, tmp_path):
    text = "X.1,Republicans/Republican leaners,Democrats/Democratic leaners\n,%,%\n2024 Feb 1-20,45,46\n"
    (tmp_path / "lean.csv").write_text(text)
    (row,) = surveys.read_leaner_survey(spark, str(tmp_path / "lean.csv")).collect()
    assert (row["republican_leaners"], row["democratic_leaners"]) == (45.0, 46.0)


def test_survey_without_columns(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        surveys.read_party_survey(spark, str(tmp_path / "bad.csv"))


HOUSE = (
    "year,state,state_po,office,district,stage,runoff,special,candidate,party,writein,mode,candidatevotes,totalvotes\n"
    '1976,ALABAMA,AL,US HOUSE,1,GEN,FALSE,FALSE,"EDWARDS, ""JACK""",REPUBLICAN,FALSE,TOTAL,98257,157170\n'
    "1976,ALABAMA,AL,US HOUSE,2,GEN,FALSE,FALSE,DOE,,TRUE,TOTAL,x,157170\n"
    "1978,ALASKA,AK,US HOUSE,0,PRI,FALSE,FALSE,ROE,DEMOCRAT,FALSE,TOTAL,7,7\n"
)


@pytest.fixture
def house_csv(tmp_path):
    (tmp_path / "house.csv").write_text(HOUSE)
    return str(tmp_path / "house.csv")


def test_read_house_filters_and_types(spark, house_csv):
    df = elections.read_house(spark, house_csv, years="1976", districts="1")
    (row,) = df.collect()
    assert row.asDict() == {
        "year": 1976, "state": "ALABAMA", "office": "US HOUSE", "candidate": 'EDWARDS, "JACK"',
        "party": "REPUBLICAN", "votes": 98257, "total_votes": 157170,
    }
    assert elections.read_house(spark, house_csv, states=["ALASKA"]).count() == 1
    assert elections.read_house(spark, house_csv).count() == 3


def test_csv_scan_reads_only_used_columns(spark, house_csv):
    plan = elections.read_house(spark, house_csv).select("year", "votes")._jdf.queryExecution().executedPlan().toString()
    assert "runoff" not in plan.split("ReadSchema")[1]


def test_read_election_old_file(spark, house_csv):
    rows = elections.read_election(spark, house_csv, "house").orderBy("year", "district").collect()
    assert [r["candidatevotes"] for r in rows] == [98257.0, 0.0, 7.0]
    assert rows[1]["party"] == "" and rows[1]["writein"] is True
    assert rows[0]["year"] == 1976


def test_new_format_edges(spark):
    df = spark.createDataFrame(
        [
            (1, "oh", "OH", "District 7", 2022, "general", None, "Ann", "W", "5"),
            (2, None, "OH", "District 12345", 2022, None, True, "nan", None, "n/a"),
            (3, "oh", "OH", None, 2022, "general", False, "Bob", "dem", None),
        ],
        "race_id int, state string, state_abbrev string, office_seat_name string, cycle int, stage string, "
        "special boolean, candidate_name string, ballot_party string, votes string",
    )
    assert is_new_format(df)
    rows = import_election(df, "house").orderBy("district").collect()
    assert [r["district"] for r in rows] == ["000", "007", "12345"]
    assert [r["candidate"] for r in rows] == ["BOB", "ANN", ""]
    assert [r["writein"] for r in rows] == [False, True, False]
    assert [r["stage"] for r in rows] == ["GENERAL", "GENERAL", ""]
    assert [r["special"] for r in rows] == ["FALSE", "", "TRUE"]
    assert [r["totalvotes"] for r in rows] == [0.0, 5.0, 0.0]  # the sum of the race
    with pytest.raises(ValueError):
        import_election(df, "mayor")


def test_mapping_document(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps(mappings.DEFAULT_MAPPINGS, indent=1))
    assert mappings.read_mapping(spark, str(tmp_path / "map.json")) == mappings.DEFAULT_MAPPINGS
    df = spark.createDataFrame([(2020, "x", "w", "3")], "year int, state string, party_detailed string, candidatevotes string")
    (row,) = standardize_by_mapping(df, "president").collect()
    assert row.asDict() == {"year": 2020, "state": "X", "party": "W", "candidatevotes": 3.0}
    with pytest.raises(ValueError):
        standardize_by_mapping(df, "mayor")


def test_validate_reports_every_check(spark):
    df = spark.createDataFrame(
        [
            (2000, "A", "A", "x", "P", "10", 15.0, "1", 1),
            (2000, "A", "A", "y", "P", "-5", 15.0, "1", 7),
            (2000, "B", "B", "z", "P", "bad", 4.0, "1", None),
            (2000, None, "B", "z", "P", "1", 4.0, "1", 2),
        ],
        "year int, state string, state_po string, candidate string, party string, candidatevotes string, "
        "totalvotes double, district string, class int",
    )
    found = {r["check"]: (r["offending"], r["passed"]) for r in validate(df, "senate").collect()}
    assert found == {
        "required_columns": (2, False),
        "numeric_votes": (1, False),
        "nonnegative_votes": (1, False),
        "senate_class": (2, False),
        "race_totals": (2, False),
    }
    assert [r["check"] for r in validate(df.drop("candidatevotes"), "senate").collect()] == ["required_columns"]


def test_write_and_export(spark, tmp_path):
    df = spark.createDataFrame([(2000, "a", None), (2004, "b", 1)], "year int, state string, votes int")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    sinks.write_table(df, str(tmp_path / "p"), "parquet", partition_by=["year"])
    plan = spark.read.parquet(str(tmp_path / "p")).where("year = 2000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    sinks.export_bundle({"x/y": df}, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "x" / "y")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "o"), "orc")


def test_compass_document(spark, tmp_path):
    document = {
        "political_compass": {
            "dimensions": [
                {"name": "left_right", "description": "d", "range": [-1.0, 1.0], "labels": {"-1.0": "L", "1.0": "R"}}
            ],
            "model_config": {
                "target_distribution": {
                    "n_modes": 2, "mode_centers": [[0.0, 1.0], [2.0, 3.0]], "mode_weights": [1.0, 3.0], "mode_scale": 0.2
                }
            },
        }
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(document, indent=2))
    (dim,) = compass.read_dimensions(spark, str(path)).collect()
    assert (dim["label"], dim["range"], dim["labels"]["1.0"]) == ("Left Right", [-1.0, 1.0], "R")
    modes = compass.read_modes(spark, str(path)).orderBy("mode_id").collect()
    assert [(m["center"], m["weight"], m["scale"]) for m in modes] == [([0.0, 1.0], 0.25, 0.2), ([2.0, 3.0], 0.75, 0.2)]
    del document["political_compass"]["model_config"]["target_distribution"]["mode_weights"]
    path.write_text(json.dumps(document))
    assert [m["weight"] for m in compass.read_modes(spark, str(path)).collect()] == [0.5, 0.5]


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_years_prune_folders(spark, tmp_path, house_csv, format):
    """A table in one folder per year: other years are not listed, and the rows are the file's."""
    path = str(tmp_path / "by_year")
    sinks.write_table(elections.read_csv_text(spark, house_csv), path, format, partition_by=["year"])
    read = elections.read_house(spark, path, years="1976", format=format)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = 1976", plan)
    assert sorted(read.collect(), key=str) == sorted(elections.read_house(spark, house_csv, years="1976").collect(), key=str)
    assert elections.read_house(spark, path, format=format).count() == elections.read_house(spark, house_csv).count()


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="csv or parquet"):
        elections.read_senate(spark, "nowhere", format="orc")
