"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from compare import rows

from lodestone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
