"""Filters and sort orders of the dashboard questions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.values import MILLIS_PER_DAY
from sessionmill.schemas import SESSION_KEY


# Sums of doubles differ in their last digits with the order of addition; sorted by so many places, rows that
# should be equal are, and their ties decide.
DOUBLES = ("spend", "cost", "avg_cost_per_session", "duration_sec")
PLACES = 9


@dataclass(frozen=True)
class Sort:
    """How a table is sorted: columns to choose by name, the default one, and what decides among equals ('-': descending)."""

    columns: Mapping[str, str]
    default: str | None
    ties: tuple[str, ...]


# The columns each table may be sorted by.
SORTS = {
    "harnesses": Sort(
        {"harness": "harness", "spend": "spend", "tokens": "tokens", "turns": "turns", "tools": "tools"}, "spend", ("harness",)
    ),
    "providers": Sort({"provider": "provider", "spend": "spend", "tokens": "tokens", "tools": "tools"}, "spend", ("provider",)),
    "models": Sort(
        {"model": "model", "provider": "provider", "spend": "spend", "avg_cost": "avg_cost_per_session", "tokens": "tokens",
         "tools": "tools"},
        "tokens", ("model", "provider"),
    ),
    "projects": Sort(
        {"project": "project", "spend": "spend", "sessions": "sessions", "avg_duration": "avg_duration"}, "spend", ("project",)
    ),
    "tools": Sort({"tool": "tool", "count": "count", "errors": "errors"}, "count", ("tool",)),
    "model_tools": Sort(
        {"model": "model", "provider": "provider", "tool": "tool", "count": "count", "errors": "errors"},
        "count", ("model", "provider", "tool"),
    ),
    "sessions": Sort(
        {"when": "start_time", "project": "project", "spend": "cost", "tokens": "total_tokens", "duration": "duration_sec",
         "turns": "agent_turns"},
        "start_time", ("harness", "filename"),
    ),
    "timeline": Sort({}, None, ("date",)),
    "profanity_model_harnesses": Sort({}, "count", ("-feel_score", "harness", "model", "provider")),
}


@dataclass(frozen=True)
class Filters:
    """Optional restrictions; an empty value does not restrict.

    ``as_of`` is the day the look-back of ``days`` counts from, today (UTC) if
    not given.
    """

    days: int = 0
    project: str = ""
    filename: str = ""
    harness: str = ""
    provider: str = ""
    model: str = ""
    tool: str = ""
    sort_table: str = ""
    sort_by: str = ""
    sort_dir: str = "desc"
    as_of: dt.date | None = None

    @classmethod
    def from_strings(cls, values: Mapping[str, str], as_of: dt.date | None = None) -> Filters:
        """From request-like texts: unreadable days mean 0, any order but 'asc' is descending."""
        names = ("project", "filename", "harness", "provider", "model", "tool", "sort_table", "sort_by")
        texts = {name: values.get(name, "") for name in names}
        direction = "asc" if values.get("sort_dir") == "asc" else "desc"
        return cls(days=_days(values.get("days", "")), sort_dir=direction, as_of=as_of, **texts)

    def but(self, **changes) -> Filters:
        return replace(self, **changes)

    def equal(self, frame: DataFrame, *names: str) -> DataFrame:
        """Rows whose columns equal the set filters among ``names``."""
        for name in names:
            if getattr(self, name):
                frame = frame.where(F.col(name) == getattr(self, name))
        return frame

    def recent(self, frame: DataFrame) -> DataFrame:
        """Sessions started within the look-back."""
        if self.days == 0:
            return frame
        first = (self.as_of or dt.datetime.now(dt.timezone.utc).date()) - dt.timedelta(days=self.days)
        return frame.where(F.col("start_time") >= (first - dt.date(1970, 1, 1)).days * MILLIS_PER_DAY)

    def in_sessions(self, frame: DataFrame, sessions: DataFrame) -> DataFrame:
        """Rows of sessions that pass the look-back and project filters."""
        if not (self.days or self.project):
            return frame
        return matching(frame, self.equal(self.recent(sessions), "project"))

    def having(self, frame: DataFrame, other: Callable[[], DataFrame], *names: str) -> DataFrame:
        """Rows whose session has, per set filter, some row of ``other()`` equal to it; not asked for if no filter is set."""
        for name in names:
            if getattr(self, name):
                frame = matching(frame, self.equal(other(), name))
        return frame

    def with_tool(self, sessions: DataFrame) -> DataFrame:
        """Sessions that name the tool."""
        return sessions.where(F.map_contains_key("tool_breakdown", F.lit(self.tool))) if self.tool else sessions

    def keys(self, table: str, sort: Sort | None = None) -> list[tuple[str, bool]]:
        """(column, ascending) by which a table is sorted: the chosen column, the default one descending, then the ties.

        Unknown tables and columns choose nothing. No two rows of a table agree in all keys.
        """
        sort = sort or SORTS[table]
        chosen = sort.columns.get(self.sort_by) if self.sort_table == table else None
        keys = [(chosen, self.sort_dir == "asc")] if chosen else []
        keys += [(sort.default, False)] if sort.default else []
        keys += [(name.removeprefix("-"), not name.startswith("-")) for name in sort.ties]
        return _first(keys)

    def order(self, table: str, columns: Mapping[str, str], default: str) -> list[Column]:
        """Sort columns of a table that has no ties of its own."""
        return _sorted_by(self.keys(table, Sort(columns, default, ())))

    def sort(self, table: str) -> list[Column]:
        """Sort columns of a table; NULLs go last in either direction."""
        return _sorted_by(self.keys(table))


def _first(keys: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """A column named again decides nothing more."""
    return [key for i, key in enumerate(keys) if key[0] not in [name for name, _ in keys[:i]]]


def _sorted_by(keys: list[tuple[str, bool]]) -> list[Column]:
    return [sort_key(name).asc_nulls_last() if up else sort_key(name).desc_nulls_last() for name, up in keys]


def sort_key(name: str) -> Column:
    """What a column is sorted by: doubles by ``PLACES`` places."""
    return F.round(name, PLACES) if name in DOUBLES else F.col(name)


def _days(text: str) -> int:
    # A signed 32-bit decimal number; anything else, '' and 'all' included, is 0.
    body = text[1:] if text[:1] in ("+", "-") else text
    if not (body.isascii() and body.isdigit()):
        return 0
    number = int(text)
    return number if -(2**31) <= number < 2**31 else 0


def matching(frame: DataFrame, other: DataFrame, keys: list[str] = SESSION_KEY) -> DataFrame:
    """Rows with a partner in ``other``.

    Partners are made distinct before the shuffle, so a session with many of
    them sends one row.
    """
    return frame.join(other.select(*keys).distinct(), keys, "left_semi")
