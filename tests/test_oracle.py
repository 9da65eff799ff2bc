"""Every query with an SQL statement gives the rows of that statement."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, key):
    assert difference(entry.queries()[key](spark, SF), con, entry.oracle_sql()[key]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
