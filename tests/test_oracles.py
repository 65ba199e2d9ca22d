import pytest
from tests.compare import assert_equal, connected

import __spark_entry__ as entry
from archloom.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert_equal(QUERIES[name], ORACLES[name], spark, FOLDER, con)


def test_flow_trace_runs(spark):
    found = QUERIES["flow_trace"](spark, FOLDER)
    assert found.where("pos = 0").count() == found.select("flow").distinct().count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
