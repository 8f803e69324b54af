"""Incremental ingest: only files that arrived are read, only their sessions rebuilt.

All rollups are per session and a session is one file (one id for the relational source), so a batch can be rolled up on
its own.  Each batch is written under a version of its own: the time it was first begun, the writer and the batch's
number.  Versions sort by that time, so whatever was read last wins, and no two writers share one.  A row per session is added
to an index last; readers take the newest version of each session, and `compact` merges what batches wrote.  A batch that is run again after a failure finds its
version on record and rewrites exactly that.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.plans.refresh import write_tables
from sessionmill.plans.store import TABLES, Rollups
from sessionmill.schemas import SESSION_KEY
from sessionmill.sources import claude, codex, gemini, pi, readers
from sessionmill.sources.registry import Prices
from sessionmill.streaming import compact
from sessionmill.streaming.compact import INDEX

# source: (path under home, schema, reader options)
_RECURSIVE = {"recursiveFileLookup": "true", "pathGlobFilter": "*.jsonl"}
LANDINGS = {
    "pi": (pi.GLOB, pi.RAW, {}),
    "claude": (claude.FOLDER, claude.RAW, _RECURSIVE),
    "codex": (codex.FOLDER, codex.RAW, _RECURSIVE),
    "gemini": (gemini.GLOB, gemini.RAW, {"multiLine": "true"}),
}
BATCHES = "batches"


def store_batch(
    spark: SparkSession,
    source: str,
    raw: DataFrame,
    version: str,
    out: str,
    prices: Prices,
    terms: list[tuple[str, str, str]] | None = None,
) -> None:
    """Roll up the sessions of some files and make them the current version of those sessions."""
    def place(table: str) -> str:
        return f"{out}/{table}/source={source}/version={version}"

    tables = write_tables(spark, {source: raw}, prices, terms, place)
    keys = tables.events.select(*SESSION_KEY).distinct()
    keys.write.mode("overwrite").parquet(place(INDEX))


def stream_source(
    spark: SparkSession,
    source: str,
    home: str,
    out: str,
    checkpoint: str,
    prices: Prices,
    terms: list[tuple[str, str, str]] | None = None,
    max_files: int = 100_000,
    every: str | None = None,
) -> StreamingQuery:
    """Follow a folder of finished log files.

    The file source hands every path over once, so this fits files that are
    complete when they land.  ``every`` ('5 minutes') keeps the query running;
    without it the query ends when all files present are done.
    """
    path, schema, options = LANDINGS[source]
    reader = spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", max_files)
    landed = readers.with_file_name(reader.json(f"{home}/{path}"))

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # Spark's id of the query lives in its checkpoint: the same after a restart, another for another checkpoint.
        writer = session.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        store_batch(session, source, batch, recorded_version(session, out, source, writer, number), out, prices, terms)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        landed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def new_version(writer: str, number: int = 0) -> str:
    """Sorts by the time of its making."""
    now = dt.datetime.now(dt.timezone.utc)
    return f"{now:%Y%m%dT%H%M%S%f}-{writer}-{number}"


def recorded_version(spark: SparkSession, out: str, source: str, writer: str, number: int) -> str:
    """The version of a batch of a stream, the same whenever the batch is run."""
    path = f"{out}/{BATCHES}"
    try:
        known = spark.read.schema("source string, writer string, number long, version string").parquet(path)
        found = known.where((F.col("source") == source) & (F.col("writer") == writer) & (F.col("number") == number)).agg(F.min("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        found = new_version(writer, number)
        row = spark.createDataFrame([(source, writer, number, found)], "source string, writer string, number long, version string")
        row.coalesce(1).write.mode("append").parquet(path)
    return found


def store_changed(
    spark: SparkSession,
    source: str,
    home: str,
    out: str,
    since: dt.datetime,
    prices: Prices,
    terms: list[tuple[str, str, str]] | None = None,
) -> bool:
    """Read files modified after ``since`` as a whole: for logs that are appended in place.

    ``since`` must name its time zone.  Of the relational source the sessions are read that have a message or part
    created after it.  What is read becomes the newest version, whatever ``since`` was.  False if nothing changed.
    """
    if since.tzinfo is None:
        raise ValueError("since must have a time zone")
    since = since.astimezone(dt.timezone.utc)
    version = new_version(uuid.uuid4().hex)
    if source == "opencode":
        raw = readers.if_present(lambda: changed_tables(readers.read_opencode(spark, f"{home}/opencode"), since))
    else:
        path, schema, options = LANDINGS[source]
        reader = spark.read.schema(schema).options(**options).option("timeZone", "UTC").option("modifiedAfter", f"{since:%Y-%m-%dT%H:%M:%S}")
        raw = readers.if_present(lambda: readers.with_file_name(reader.json(f"{home}/{path}")))
    if raw is None:
        return False
    store_batch(spark, source, raw, version, out, prices, terms)
    return True


def changed_tables(raw: dict[str, DataFrame], since: dt.datetime) -> dict[str, DataFrame]:
    """The tables cut to sessions that have a row created after ``since``."""
    after = int(since.timestamp() * 1000)
    changed = reduce(
        DataFrame.unionByName,
        [raw[t].where(F.col("time_created") > after).select(F.col("session_id").cast("string").alias("_id")) for t in ("message", "part")],
    ).distinct()
    keys = {"message": "session_id", "part": "session_id", "session": "id"}
    return {
        t: frame.join(changed, frame[keys[t]].cast("string") == changed["_id"], "left_semi") for t, frame in raw.items()
    }


def load(spark: SparkSession, out: str) -> Rollups:
    """All tables with the newest version of every session.

    Source and version are partition columns, so any number of batches is one
    scan, and the plan does not grow with them.  Of what was compacted, the last
    generation is read.
    """
    generation = compact.last_generation(spark, out)
    holds = compact.newest(compact.stored(spark, out, INDEX, generation))

    def table(name: str) -> DataFrame:
        return compact.current(compact.stored(spark, out, name, generation), holds).drop(*compact.BATCH)

    return Rollups(**{name: table(name) for name in TABLES})
