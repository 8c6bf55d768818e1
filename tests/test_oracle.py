"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    outcome, _, n = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert outcome in ("match", "rows-only"), outcome
    assert n > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
