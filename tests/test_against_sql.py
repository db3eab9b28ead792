"""Every registered query with SQL gives the same rows and types in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import database, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    ours = queries()[name](spark, SMALL).toArrow()
    assert len(set(ours.column_names)) == len(ours.column_names)
    if name in oracle_sql():
        theirs = connection.sql(oracle_sql()[name]).to_arrow_table()
        assert differences(ours, theirs) == []
    else:
        assert ours.num_rows > 0


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "TransactionID"
