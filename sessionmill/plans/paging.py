"""Answers a page at a time.

A page starts behind the last row of the page before, found by the values that row is sorted by (its cursor), not by its
position: no rows are counted or skipped, at most one page comes to the driver, and a row is neither left out
nor shown twice if others appear meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sessionmill.plans import overview, terms
from sessionmill.plans.filters import DOUBLES, PLACES, Filters, sort_key
from sessionmill.plans.store import Rollups

_PAGED: dict[str, Callable[[Rollups, Filters], DataFrame]] = {
    "harnesses": overview.harnesses,
    "providers": overview.providers,
    "models": overview.models,
    "projects": overview.projects,
    "tools": overview.tools,
    "model_tools": overview.model_tools,
    "timeline": terms.timeline,
    "profanity_model_harnesses": terms.term_model_harnesses,
}
PAGED = (*_PAGED, "sessions")


@dataclass(frozen=True)
class Page:
    """Some rows of an answer and the cursor of the page behind them; None on the last page."""

    rows: list[Row]
    next: str | None


def page(table: str, r: Rollups, f: Filters = Filters(), size: int = 25, cursor: str | None = None) -> Page:
    """``size`` rows of a table in its order, from the beginning or from behind ``cursor``.

    A cursor belongs to a table and an order; with another it is an error. Filters may differ from page to page.
    """
    if table not in PAGED:
        raise ValueError(f"no pages of {table!r}; of {', '.join(PAGED)}")
    if size < 1:
        raise ValueError("a page has at least one row")
    keys = f.keys(table)
    last = _values(table, keys, cursor)

    def part(frame: DataFrame) -> DataFrame:
        return frame if last is None else frame.where(_behind(keys, last))

    # One row more than asked for tells whether there is another page.
    if table == "sessions":
        rows = overview.listed_sessions(r, f, size + 1, part=part).collect()
        found, shown = [tuple(row["_key"]) for row in rows], [_without(row, "_key") for row in rows]
    else:
        shown = part(_PAGED[table](r, f)).orderBy(*f.sort(table)).limit(size + 1).collect()
        found = [tuple(row[name] for name, _ in keys) for row in shown]
    more = len(shown) > size
    return Page(shown[:size], json.dumps([table, keys, found[size - 1]]) if more else None)


def _values(table: str, keys: Sequence[tuple[str, bool]], cursor: str | None) -> list | None:
    if cursor is None:
        return None
    try:
        of, by, values = json.loads(cursor)
    except ValueError as error:
        raise ValueError("not a cursor") from error
    if of != table or by != [list(key) for key in keys] or len(values) != len(keys):
        raise ValueError("a cursor of another table or order")
    return values


def _behind(keys: Sequence[tuple[str, bool]], last: Sequence) -> Column:
    """Whether a row comes after the one with the key values ``last``; NULLs are last."""
    found = F.lit(False)
    for (name, up), value in reversed(list(zip(keys, last))):
        key = sort_key(name)
        if value is None:
            found = key.isNull() & found
            continue
        bound = F.round(F.lit(value), PLACES) if name in DOUBLES else F.lit(value)
        found = key.isNull() | ((key > bound) if up else (key < bound)) | ((key == bound) & found)
    return found


def _without(row: Row, name: str) -> Row:
    return Row(**{k: v for k, v in row.asDict().items() if k != name})
