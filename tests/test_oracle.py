"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import ROOT, compare, connection

SF_DIR = str(ROOT / "sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    ok, message = compare(QUERIES[name], ORACLES.get(name), spark, con, SF_DIR)
    assert ok is not False, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
