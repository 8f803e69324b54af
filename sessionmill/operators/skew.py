"""Joining past keys that hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def row_hash(rows: DataFrame) -> Column:
    """A hash of a row's columns but maps, which have no order to hash by."""
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain)


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``facts``, at most one row per key, to many ``rows`` per key; ``how`` is 'left' or 'inner'.

    Adaptive execution cannot split a hot key here, because the facts come out of an aggregation that already has the
    join's partitioning. So every key's rows are dealt over ``salts`` partitions by a hash of the row, and each fact is
    there once per salt. A row lands in the same place when its task is run again.
    """
    keys = list(keys)
    salt = F.pmod(row_hash(rows), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    salted = rows.withColumn("_salt", salt).join(facts.withColumn("_salt", copies), [*keys, "_salt"], how)
    return salted.drop("_salt")
