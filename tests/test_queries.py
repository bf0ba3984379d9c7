import pytest

from folioflow import registry
from tests.conftest import DATA
from tests.same import agrees

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, registry.queries()[name], SQL[name], f"{DATA}/sf0.001")


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
