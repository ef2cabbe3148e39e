"""Every registered query that has SQL against DuckDB, and the others for their rows."""

import pytest

from lumenark.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SLOW = {"kmeans_fit", "kmeans_choose", "network_classify"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(connect(data), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - SLOW))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_has_the_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
