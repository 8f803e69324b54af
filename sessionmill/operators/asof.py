"""As-of lookup as a prefix scan over a tree of time spans.

``asof`` gives every point the latest state at or before it (or, forward, the earliest at or after it) within its key.
A key's time line is cut into spans, those into shorter spans, and so on (``widths``: hours of seconds). A first pass goes up the
tree: the last state of each span is the greatest of its parts. A second goes down: each span starts with the state carried into
it, which is the last one of the spans before it under the same parent, or else what was carried into the parent. At
last points and states of a shortest span meet in one running window that starts with the span's carried state.

A window thus never holds more than the parts of one span, a number that ``widths`` fix and the data cannot exceed; only the
distinct longest spans of a key meet in one window. Neither a key nor an hour with most of all rows is one task, and
the layout is the same for every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.operators.skew import join_facts

# Milliseconds: a second, an hour.
SPANS = (1_000, 3_600_000)


def asof(
    points: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: str,
    forward: bool = False,
    how: str = "left",
    widths: Sequence[int] = SPANS,
    by_instant: bool = False,
) -> DataFrame:
    """``points`` plus column ``payload`` taken from ``states``.

    ``points`` and ``states`` both hold ``keys`` and ``time``; ``payload`` is an orderable non-null column of ``states``.
    Of several states at one instant the largest payload wins. NULL keys or times match nothing. ``how`` is 'left'
    (unmatched points keep a NULL payload) or 'inner'. ``widths`` are the lengths of spans in units of ``time``, shortest
    first, each a multiple of the one before; they decide the layout, not the answer.

    ``by_instant`` looks up the distinct instants and joins the answers back to the points: for points of which very
    many may share an instant.
    """
    if any(longer % shorter for shorter, longer in zip(widths, widths[1:])):
        raise ValueError(f"each width is to be a multiple of the one before: {tuple(widths)}")
    keys = list(keys)
    matchable = F.col(time).isNotNull()
    for key in keys:
        matchable = matchable & F.col(key).isNotNull()
    instant = -F.col(time) if forward else F.col(time)
    known = points.where(matchable)
    if by_instant:
        at = known.select(*keys, time).distinct()
        answers = _lookup(at, states.where(matchable), keys, instant, payload, widths)
        found = join_facts(known, answers, [*keys, time])
    else:
        found = _lookup(known, states.where(matchable), keys, instant, payload, widths)
    found = found.select(*points.columns, payload)
    if how == "inner":
        return found.where(F.col(payload).isNotNull())
    never = points.where(~matchable).withColumn(payload, F.lit(None).cast(states.schema[payload].dataType))
    return found.unionByName(never)


def _lookup(points: DataFrame, states: DataFrame, keys: list[str], instant, payload: str, widths: Sequence[int]) -> DataFrame:
    span = F.floor(F.col("_at") / widths[0]).alias("_span")
    collapsed = (
        states.select(*keys, instant.alias("_at"), F.col(payload).alias("_state"))
        .groupBy(*keys, "_at").agg(F.max("_state").alias("_state"))
        .select(*keys, "_at", "_state", span)
    )
    point_columns = [F.col(f"`{c}`") for c in points.columns]
    placed = points.select(*keys, instant.alias("_at"), F.struct(*point_columns).alias("_point")).select(
        *keys, "_at", "_point", span
    )
    # One row per span that holds anything, with the last state in it, if any.
    last = F.max(F.when(F.col("_state").isNotNull(), F.struct("_at", "_state"))).alias("_last")
    spans = (
        collapsed.unionByName(placed.select(*keys, "_span"), allowMissingColumns=True)
        .groupBy(*keys, "_span").agg(last)
    )
    ratios = [longer // shorter for shorter, longer in zip(widths, widths[1:])]
    carried = _carried(spans, keys, ratios).select(*keys, "_carry._at", "_carry._state", "_span")
    both = placed.unionByName(collapsed, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # On one instant states (no point) come first.
    running = (
        Window.partitionBy(*keys, "_span")
        .orderBy("_at", F.col("_point").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("_found", F.last("_state", ignorenulls=True).over(running))
        .where(F.col("_point").isNotNull())
        .select("_point.*", F.col("_found").alias(payload))
    )


def _carried(spans: DataFrame, keys: list[str], ratios: Sequence[int]) -> DataFrame:
    """(keys, _span, _carry) of the spans some state comes before; ``spans`` is (keys, _span, _last).

    ``ratios`` says how many spans make one of the next length, level by level; above the last, all spans of a key do.
    """
    together, rows = keys, spans
    if ratios:
        rows = spans.withColumn("_parent", F.floor(F.col("_span") / ratios[0]))
        parents = rows.groupBy(*keys, F.col("_parent").alias("_span")).agg(F.max("_last").alias("_last"))
        # What is carried into the parent stands before its first part.
        entries = _carried(parents, keys, ratios[1:]).select(
            *keys, F.lit(None).cast("bigint").alias("_span"), F.col("_carry").alias("_last"), F.col("_span").alias("_parent")
        )
        together, rows = [*keys, "_parent"], rows.unionByName(entries)
    before = Window.partitionBy(*together).orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
    return found.where(F.col("_span").isNotNull() & F.col("_carry").isNotNull()).select(*keys, "_span", "_carry")
