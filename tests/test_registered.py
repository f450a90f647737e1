"""Every registered query with SQL must equal it; the others must run."""

import importlib

import pytest
from check import compare, connect

from tagloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert ok, note


def test_entry_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["code", "n", "pct"]
