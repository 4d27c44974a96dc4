"""Every registered query against its SQL twin on the sf0.01 tables."""

import importlib.util
import os
from pathlib import Path

import pytest

import parity

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01")
_spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).parent.parent / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF_DIR)


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert parity.compare(spark, con, SF_DIR, QUERIES[name], SQL[name]) == []


def test_entry_has_rows(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 72 and len(rows[0]) == 34
