import pytest
from tests.compare import assert_equal, connected

from archloom.llm.oracles import ORACLES
from archloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_equal(QUERIES[name], ORACLES[name], spark, FOLDER, connected(FOLDER))
