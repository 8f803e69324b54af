"""The questions a page asks together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row

from sessionmill.plans import overview, paging, terms
from sessionmill.plans.filters import Filters
from sessionmill.plans.store import Rollups

_QUESTIONS = {
    "summary": overview.summary,
    "harnesses": overview.harnesses,
    "providers": overview.providers,
    "models": overview.models,
    "projects": overview.projects,
    "tools": overview.tools,
    "model_tools": overview.model_tools,
    "timeline": terms.timeline,
    "sessions": overview.session_list,
    "session_count": overview.session_count,
    "profanity_summary": terms.term_summary,
    "profanity_groups": terms.term_groups,
    "profanity_models": terms.term_models,
    "profanity_model_harnesses": terms.term_model_harnesses,
    "profanity_harnesses": terms.term_harnesses,
}

# What each page shows.
VIEWS = {
    "dashboard": (
        "summary", "harnesses", "providers", "models", "tools", "sessions", "session_count", "profanity_summary",
    ),
    "drill": (
        "summary", "models", "tools", "timeline", "sessions", "session_count", "profanity_summary", "profanity_groups",
    ),
    "session": ("model_tools", "sessions", "session_count"),
    "profanity": (
        "profanity_summary", "profanity_groups", "profanity_models", "profanity_model_harnesses",
        "profanity_harnesses",
    ),
}


def bundle(view: str, rollups: Rollups, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """Lazy frames of a page by name; the session list is cut to the rows shown."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; one of {', '.join(VIEWS)}")
    frames = {name: _QUESTIONS[name](rollups, filters) for name in VIEWS[view]}
    if "sessions" in frames:
        frames["sessions"] = frames["sessions"].limit(overview.SHOWN_SESSIONS)
    if view == "session" and filters.harness and filters.filename:
        frames["session_profanity"] = terms.session_terms(rollups, filters.harness, filters.filename)
    return frames


def answer(frames: dict[str, DataFrame], at_once: int = 4) -> dict[str, list[Row]]:
    """Collect a page's small result tables, submitting several questions at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        collected = pool.map(DataFrame.collect, frames.values())
        return dict(zip(frames, collected))


def answer_pages(
    view: str, rollups: Rollups, filters: Filters = Filters(), size: int = 25, at_once: int = 4
) -> dict[str, paging.Page]:
    """The first page of each question of a view; ``paging.page`` gives the others.

    Questions that are not paged have one row, or a number of rows that they limit themselves.
    """

    def first(name: str, frame: DataFrame) -> paging.Page:
        if name in paging.PAGED:
            return paging.page(name, rollups, filters, size)
        return paging.Page(frame.collect(), None)

    frames = bundle(view, rollups, filters)
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(frames, pool.map(first, frames.keys(), frames.values())))
