"""Queries over all sources' raw logs make, parse and search each log once: what is returned starts from stored tables."""

import os

import pytest

from workload.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read_by(frame):
    """Names of the input files' folders, or of files that are no folder's part."""
    return {path.rsplit("/", 1)[1] if path.endswith("/events.parquet") else path.rsplit("/", 2)[1] for path in frame.inputFiles()}


@pytest.mark.parametrize("name", ["unified_events", "pipeline_sessions", "pipeline_hits"])
def test_starts_from_stored_tables(spark, name):
    frame = QUERIES[name](spark, SF)
    assert not {"events.parquet", "part.parquet"} & read_by(frame)
    # Stored prices have a known size, so no rows are dealt by their model.
    assert "hashpartitioning(p_model" not in frame._jdf.queryExecution().executedPlan().toString()
