"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from gitloom.plans import QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    assert compare(con, frame, ORACLES[name]) is None


def test_history_queries_all_have_sql():
    assert set(QUERIES) <= set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
