"""Which assistant turn was in force: for tool calls and for term hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.operators.asof import asof
from sessionmill.schemas import ATTRIBUTED_HIT, SESSION_KEY


def turns(events: DataFrame) -> DataFrame:
    """Assistant turns that name a model, as states (key, ts, turn)."""
    named = (F.col("is_turn") == 1) & F.col("model").isNotNull() & (F.col("model") != "")
    return events.where(named).select(*SESSION_KEY, "ts", F.struct("model", "provider").alias("turn"))


def tool_calls(events: DataFrame) -> DataFrame:
    """Calls and errors per session, instant and tool: a crowded instant is a few rows."""
    called = (F.col("is_tool") == 1) & F.col("tool").isNotNull()
    return events.where(called).groupBy(*SESSION_KEY, "ts", "tool").agg(
        F.expr("count(1)").alias("calls"), F.expr("count_if(is_error = 1)").alias("errors")
    )


def attribute_tools(events: DataFrame, how: str = "inner") -> DataFrame:
    """Counted tool calls with the latest turn at or before them in their session.

    'inner' drops calls before the first turn, 'left' keeps them unattributed.
    """
    found = asof(tool_calls(events), turns(events), SESSION_KEY, "ts", "turn", how=how)
    return found.select(*SESSION_KEY, "ts", "tool", "calls", "errors", "turn.model", "turn.provider")


def attribute_hits(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Term hits with the first turn at or after them; hits after the last turn stay unattributed."""
    found = asof(hits, turns(events), SESSION_KEY, "ts", "turn", forward=True, by_instant=True)
    return found.select(*hits.columns, "turn.model", "turn.provider").select(*ATTRIBUTED_HIT.fieldNames())
