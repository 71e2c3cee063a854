"""Every registered query equals its SQL run by another engine."""

from __future__ import annotations

import pytest
from parity import compare, connect

import __spark_entry__ as registered
from cellkpi.registry import oracle, queries

QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) == []


def test_all_are_registered():
    assert set(QUERIES) <= set(registered.queries())
    assert ORACLE.items() <= registered.oracle_sql().items()


def test_entry_has_rows(spark):
    assert registered.entry(spark).limit(1).count() == 1
