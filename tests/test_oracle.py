"""Every registered query against its SQL, on a whole scale factor."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference, spark_rows, type_difference

QUERIES = contract.queries()
SQL = contract.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(df, con, SQL[name]) is None
    assert type_difference(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir))[1].total() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 25
