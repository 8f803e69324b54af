"""Pages joined against the whole order, for every table and column it may be sorted by."""

import json

import pytest

from sessionmill.plans import bundles, overview, paging, terms
from sessionmill.plans.filters import SORTS, Filters
from sessionmill.plans.store import Rollups
from workload import adapter

SF = "/root/testdata/sf0.001"
WHOLE = {
    "harnesses": overview.harnesses,
    "providers": overview.providers,
    "models": overview.models,
    "projects": overview.projects,
    "tools": overview.tools,
    "model_tools": overview.model_tools,
    "sessions": lambda r, f: overview.session_list(r, f, rows=10**6),
    "timeline": terms.timeline,
    "profanity_model_harnesses": terms.term_model_harnesses,
}
# The many rows of these are cut by a filter, so that few pages are asked for.
FEWER = {"sessions": {"project": "p3"}, "model_tools": {"provider": "v1"}}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rollups"))
    r = adapter.all_rollups(spark, SF)
    tables = {}
    for name in ("events", "model_tools", "stats", "sessions", "hits"):
        getattr(r, name).coalesce(1).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    return Rollups(**tables)


def walk(table, r, f, size):
    rows, cursor = [], None
    while True:
        found = paging.page(table, r, f, size, cursor)
        rows += found.rows
        assert len(found.rows) == size or found.next is None
        cursor = found.next
        if cursor is None:
            return rows


@pytest.mark.parametrize("table", WHOLE)
def test_pages_of_seven_are_the_whole_order(spark, stored, table):
    for column in SORTS[table].columns or [""]:
        for direction in ("asc", "desc"):
            f = Filters(sort_table=table, sort_by=column, sort_dir=direction, **FEWER.get(table, {}))
            whole = WHOLE[table](stored, f).collect()
            assert len(whole) > 2
            assert walk(table, stored, f, 7 if len(whole) > 7 else 2) == whole, (column, direction)


def test_null_is_a_cursor(spark, stored):
    f = Filters(sort_table="providers", sort_by="provider", sort_dir="asc")
    assert walk("providers", stored, f, 1)[-1].provider is None


def test_cursor_of_another_order(stored):
    first = paging.page("tools", stored, Filters(), 2)
    assert json.loads(first.next)[0] == "tools"
    for table, f, cursor in [
        ("harnesses", Filters(), first.next),
        ("tools", Filters(sort_table="tools", sort_by="errors"), first.next),
        ("tools", Filters(), "nonsense"),
        ("summary", Filters(), None),
    ]:
        with pytest.raises(ValueError):
            paging.page(table, stored, f, 2, cursor)


def test_first_pages_of_a_view(stored):
    pages = bundles.answer_pages("dashboard", stored, Filters(project="p3"), size=3)
    assert list(pages) == list(bundles.VIEWS["dashboard"])
    assert [len(pages[n].rows) for n in ("summary", "tools", "sessions")] == [1, 3, 3]
    assert pages["summary"].next is None and pages["sessions"].next
