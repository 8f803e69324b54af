"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# One of the stacked filter queries stands for the others, which the driver runs.
NAMES = [n for n in QUERIES if not n.startswith("filters_") or n in ("filters_none", "filters_several")]


@pytest.fixture(scope="module")
def tables():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    assert compare.difference(spark, tables, SF, QUERIES[name], ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "harness"
