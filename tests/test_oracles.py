"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import pytest

import __spark_entry__
from tests.parity import connect, rows_of

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf), db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
