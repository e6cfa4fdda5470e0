"""Every registered query against its reference SQL on the smallest data folder."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import catalog
from tests.oracle_check import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows-only", "EMPTY"), f"{status} {rows} {note}"


def test_every_own_query_has_sql():
    queries, oracles = catalog.load()
    assert set(queries) == set(oracles)


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
