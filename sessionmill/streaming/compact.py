"""Compaction of what batches wrote: the newest rows into one generation, old folders away after a time.

A generation is a folder of its own with the newest rows of every session, each with the source and version it came from, and
the list of versions it covers. It counts from the moment a row is appended to the manifest. A reader takes the last generation and,
of the batches' folders, those it does not cover; a batch that finishes while a generation is written is not covered and is
read beside it. Rows keep their versions, so whatever was read last still wins.

Nothing is taken from a reader that has begun: folders stay until ``vacuum`` finds that the generation that covers them
is older than the time allowed for a reading. Until then covered files are still listed and skipped row by row.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.skew import join_facts
from sessionmill.plans.store import TABLES
from sessionmill.schemas import SESSION_KEY

INDEX, COMPACTED, MANIFEST, COVERED = "index", "compacted", "manifest", "covered"
BATCH = ["source", "version"]
# What a batch leaves besides its tables; nothing but a batch reads them.
LEFTOVERS = ("lexicon", "hits_raw")
PER_SOURCE = ("parsed", "found")


def generations(spark: SparkSession, out: str) -> list[tuple[str, dt.datetime]]:
    """Names and times of the generations on record, oldest first: one small row a compaction."""
    try:
        rows = spark.read.schema("generation string, made timestamp").parquet(f"{out}/{MANIFEST}").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r["generation"], r["made"].astimezone(dt.timezone.utc)) for r in rows)


def last_generation(spark: SparkSession, out: str) -> str | None:
    known = generations(spark, out)
    return f"{out}/{COMPACTED}/{known[-1][0]}" if known else None


def stored(spark: SparkSession, out: str, table: str, generation: str | None) -> DataFrame:
    """All rows of a table, old versions too, with the columns ``BATCH``; none twice."""
    path = f"{out}/{table}"
    if generation is None:
        return spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    packed = spark.read.parquet(f"{generation}/{table}")
    later = spark.read.schema(packed.schema).parquet(path).select(*packed.columns)
    return packed.unionByName(later.join(spark.read.parquet(f"{generation}/{COVERED}"), BATCH, "left_anti"))


def newest(index: DataFrame) -> DataFrame:
    """The version that holds for each session."""
    return index.groupBy(*SESSION_KEY, "source").agg(F.max("version").alias("version"))


def current(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the version that holds for their session, with all columns; ``index`` as ``newest`` gives it."""
    kept = join_facts(rows, index.withColumn("_kept", F.lit(1)), [*SESSION_KEY, *BATCH], "inner")
    return kept.select(*rows.columns)


def compact(spark: SparkSession, out: str) -> str:
    """Write the rows that hold now as a new generation; returns its name.

    Every step reads tables written before, and the manifest is written last: a compaction that fails leaves a folder
    that nobody reads.
    """
    before = last_generation(spark, out)
    made = dt.datetime.now(dt.timezone.utc)
    name = f"{made:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"
    folder = f"{out}/{COMPACTED}/{name}"
    schema = spark.read.parquet(f"{before or out}/{INDEX}").schema
    # A batch's index is written after its tables, so what is in the index is whole.
    batches = spark.read.schema(schema).parquet(f"{out}/{INDEX}").select(*(F.col(c).cast("string").alias(c) for c in BATCH)).distinct()
    batches.write.parquet(f"{folder}/{COVERED}")
    covered = spark.read.schema(batches.schema).parquet(f"{folder}/{COVERED}")
    index = stored(spark, out, INDEX, before)
    if before is None:
        known = index.join(covered, BATCH, "left_semi")
    else:  # versions whose folders are gone are in the generation before alone
        packed = spark.read.parquet(f"{before}/{INDEX}").select(*BATCH).distinct()
        known = index.join(covered.unionByName(packed).distinct(), BATCH, "left_semi")
    newest(known).write.parquet(f"{folder}/{INDEX}")
    holds = spark.read.parquet(f"{folder}/{INDEX}")
    for table in TABLES:
        parts = ["harness"] if table == "events" else []
        current(stored(spark, out, table, before), holds).write.partitionBy(*parts).parquet(f"{folder}/{table}")
    record = spark.createDataFrame([(name, made)], "generation string, made timestamp")
    record.coalesce(1).write.mode("append").parquet(f"{out}/{MANIFEST}")
    return name


def vacuum(spark: SparkSession, out: str, reading: dt.timedelta) -> int:
    """Delete what generations older than ``reading``, the longest a reader may take, have made superfluous.

    Returns the number of folders deleted. A batch's index goes last, so a run that was interrupted is taken up by the next.
    """
    old = [name for name, made in generations(spark, out) if made <= dt.datetime.now(dt.timezone.utc) - reading]
    if not old:
        return 0
    jvm = spark.sparkContext._jvm
    conf, deleted = spark.sparkContext._jsc.hadoopConfiguration(), 0

    def delete(path: str) -> int:
        place = jvm.org.apache.hadoop.fs.Path(path)
        return int(place.getFileSystem(conf).delete(place, True))

    for row in spark.read.parquet(f"{out}/{COMPACTED}/{old[-1]}/{COVERED}").toLocalIterator():
        names = [*TABLES, *LEFTOVERS, *(f"{kind}/{row['source']}" for kind in PER_SOURCE), INDEX]
        for table in names:
            deleted += delete(f"{out}/{table}/source={row['source']}/version={row['version']}")
    for name in old[:-1]:
        deleted += delete(f"{out}/{COMPACTED}/{name}")
    return deleted
