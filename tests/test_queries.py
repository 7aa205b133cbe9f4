import pytest

from oracle import compare
from wavegrid.plans import exchange, extras, long_runs  # noqa: F401  (register their queries)
from wavegrid.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)
