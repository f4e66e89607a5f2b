"""The queries that SQL can express, against their SQL, on the smallest tables."""

import oracle
import pytest

from fleetlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, monkeypatch, name):
    monkeypatch.setitem(oracle.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(oracle.ORACLES, name, ORACLES[name])
    assert oracle.compare(spark, oracle.connect(SF_DIR), name, SF_DIR) == []
