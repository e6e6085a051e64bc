import oracle
import pytest

from contactloom import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    query, statement = registry.queries()[name], registry.oracle_sql().get(name)
    if statement:
        oracle.same(spark, SF, query, statement)
    else:
        assert query(spark, SF).count() >= 0
