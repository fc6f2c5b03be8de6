import pytest

from engramite.plans import registry
from tests.oracles import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert compare(df, sql, SF) is None
    else:
        assert df.count() > 0
