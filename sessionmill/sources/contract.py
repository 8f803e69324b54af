"""What every source normaliser produces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.operators.skew import join_facts
from sessionmill.schemas import EVENT, MESSAGE

# What a normaliser does with its parsed frame before using it several times: a
# job stores it and reads it back, so that the logs themselves are scanned once.
Stage = Callable[[DataFrame], DataFrame]


def as_is(frame: DataFrame) -> DataFrame:
    return frame


_DEFAULTS = {"cost": 0.0, "in_tok": 0, "out_tok": 0, "cache_tok": 0, "is_turn": 0, "is_user": 0, "is_tool": 0, "is_error": 0}


def as_events(rows: DataFrame, harness: str, **columns: Column) -> DataFrame:
    """``rows`` projected to the event contract.

    ``columns`` gives the columns that differ from the default: zero for
    numbers and flags, NULL for text.
    """
    columns = {"harness": F.lit(harness), "filename": F.col("filename"), **columns}
    if "model" in columns:
        columns.setdefault("raw_model", columns["model"])
    return rows.select(
        *[
            columns.get(f.name, F.lit(_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in EVENT.fields
        ]
    )


def as_messages(rows: DataFrame, harness: str) -> DataFrame:
    """Rows with a text, projected to the message contract."""
    kept = rows.where(F.col("text").isNotNull())
    return kept.withColumn("harness", F.lit(harness)).select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])


def join_file_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Spread per-file facts over the file's rows.

    The facts are aggregated, with partial aggregation on the map side, and
    joined back: unlike a window over the file this holds when one file has a
    large part of all rows.
    """
    return join_facts(rows, facts, ["filename"])
