"""Session settings the plans are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime re-planning carries most of the load: a shuffle starts with far more partitions than it needs at a few
# terabytes, they are merged by measured size, and a join key that turns out hot is split. Re-planning only ever merges,
# so the initial number is what bounds a partition: 20 000 at 100 TB are 5 GB each before any filter or aggregation.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording the Python line of every column call doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "sessionmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots.

    Who sets ``spark.sql.shuffle.partitions`` has counted them and gets that number to start from.
    """
    settings = {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}
    if "spark.sql.shuffle.partitions" in settings:
        settings.pop("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        settings.pop("spark.sql.adaptive.coalescePartitions.parallelismFirst", None)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
