import pytest
from oracle import same_as_sql

from tessera.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, sf, name):
    same_as_sql(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
