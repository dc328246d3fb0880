"""Every registered query of the engine: against DuckDB where there is SQL, else that it runs and gives rows."""

import pytest
from conftest import SMALL, same_rows

from sigspark import catalog, catalog_more, catalog_rows

QUERIES, SQL = catalog.QUERIES | catalog_more.QUERIES | catalog_rows.QUERIES, catalog.ORACLE_SQL | catalog_more.ORACLE_SQL | catalog_rows.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
