"""Numbering rows in an order, without bringing a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps

# monotonically_increasing_id() holds the partition above these bits, the row's place in it below.
_PART_BITS = 33


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], steps: Steps, name: str) -> DataFrame:
    """``rows`` with ``index``, a row's place from 0 among its group's in ``order`` (nulls first), as a written table.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; ranges count their rows per group, and a row's place
    is the count of the ranges before plus its place in its own. What is summed in order is one row per range and group.
    Rows equal in group and order come in any order. Group columns must not be null.
    """
    keys = [*(F.col(g) for g in group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    placed = steps.keep(dealt, name).withColumn("_part", F.shiftright("_row", _PART_BITS))
    ranges = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, [*group, "_part"]).withColumn("index", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")
