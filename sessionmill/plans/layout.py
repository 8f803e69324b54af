"""Tables stored in buckets of their session key, so that joins and groupings by session move no row.

A bucketed table is files whose names tell their bucket, plus a catalogue entry that says so. Only the files stay: a
table is registered under a name of its own to write or to read it, and the entry goes once the frame is there. A run can
thus be read by any session, with whatever catalogue it has.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sessionmill.schemas import SESSION_KEY

# Rollups with one row per session, or a few that its models and tools bound: no bucket can be one hot session.
BUCKETED = ("model_tools", "stats", "sessions")
LAYOUT = "layout"
# Bytes of stored events to a bucket. Rollups are a small part of the events they sum up.
BUCKET_BYTES = 256 << 20
FEWEST, MOST = 8, 1 << 16


def buckets_for(events: DataFrame) -> int:
    """A power of two that grows with the files of the stored events; two runs' tables then nest in each other's buckets."""
    size = int(str(events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = 1 << max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    return min(max(wanted, FEWEST), MOST)


@contextmanager
def _entry(spark: SparkSession) -> Iterator[str]:
    name = f"mill_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def store(frame: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write ``frame`` as one file per bucket, sorted by the session key; returns the written table."""
    spark = frame.sparkSession
    with _entry(spark) as name:
        dealt = frame.repartition(buckets, *SESSION_KEY).write.bucketBy(buckets, *SESSION_KEY).sortBy(*SESSION_KEY)
        dealt.option("path", path).saveAsTable(name)
    return load(spark, path, buckets).select(*frame.columns)


def load(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    key, place = ", ".join(SESSION_KEY), path.replace("\\", "\\\\").replace("'", "\\'")
    with _entry(spark) as name:
        spark.sql(
            f"CREATE TABLE {name} ({spark.read.parquet(path).schema.toDDL()}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        return spark.table(name)


def record(spark: SparkSession, run: str, buckets: int) -> None:
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{run}/{LAYOUT}")


def recorded(spark: SparkSession, run: str) -> int | None:
    """How many buckets the tables of a run have; None for plain files."""
    try:
        return spark.read.schema("buckets int").parquet(f"{run}/{LAYOUT}").first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
