"""Every bound query against its SQL, on the tables of ``ORACLE_SF_DIR`` (default sf0.001)."""

import os

import pytest

from fleetlens.plans.queries import ORACLES, QUERIES
from oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The two tags meet in no instance of the smallest tables.
EMPTY_WHEN_SMALL = {"flt1_with_all_tags"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    problems = compare(spark, con, name, SF_DIR)
    if name in EMPTY_WHEN_SMALL:
        problems = [p for p in problems if p != "the SQL gives no rows"]
    assert problems == []
