import os

import pytest
from driftbasket.plans import registry
from oracle import same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    assert (same(df, sql, SF) if sql else df.count()) > 0
