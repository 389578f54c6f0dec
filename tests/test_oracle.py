"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from compare import connect, differences

from pollwright.catalog import registry

SF = "/root/testdata/sf0.001"
NOT_IN_PLANS = ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin")
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in NOT_IN_PLANS if op in plan]
    assert differences(df, con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["year", "party_major", "replicate", "seats", "count_win"]
    assert df.count() > 0
