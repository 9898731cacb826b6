"""Every query of the library against its SQL, run by another engine on the same tables."""

import pytest

from tallyspark import catalog

from .compare import SF_DIR, rows, tables


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF_DIR).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry_module_imports_and_lists_queries():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
