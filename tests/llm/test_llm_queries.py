import pytest

from oracle import compare
from wavegrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)
