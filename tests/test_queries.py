"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert difference(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship_is_the_same_twice(spark):
    first, second = ({tuple(r) for r in contract.entry(spark).collect()} for _ in range(2))
    assert first and first == second
