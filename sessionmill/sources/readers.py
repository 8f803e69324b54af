"""Read raw logs; one scan per source serves both its events and its messages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.sources import claude, codex, gemini, opencode, pi


def with_file_name(frame: DataFrame) -> DataFrame:
    """Column ``filename``: the plain path of the file a row came from."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    plain = F.regexp_replace(F.url_decode(encoded), "^file:(//)?", "")
    return frame.select(plain.alias("filename"), "*")


def json_lines(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """JSON Lines with a declared schema; an unreadable line becomes a row of NULLs."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    return with_file_name(reader.json(path))


def read_pi(spark: SparkSession, home: str) -> DataFrame:
    return json_lines(spark, f"{home}/{pi.GLOB}", pi.RAW)


def read_claude(spark: SparkSession, home: str) -> DataFrame:
    return json_lines(spark, f"{home}/{claude.FOLDER}", claude.RAW, recursive=True)


def read_codex(spark: SparkSession, home: str) -> DataFrame:
    return json_lines(spark, f"{home}/{codex.FOLDER}", codex.RAW, recursive=True)


def read_gemini(spark: SparkSession, home: str) -> DataFrame:
    """One document per file; a document is the unit of work, so files are spread, not split."""
    reader = spark.read.schema(gemini.RAW).option("multiLine", True)
    return with_file_name(reader.json(f"{home}/{gemini.GLOB}"))


_TABLES = {"message": opencode.MESSAGE, "session": opencode.SESSION, "part": opencode.PART}


def read_opencode(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """Exports of the three tables, ``folder/message`` and so on, as parquet or json (lines).

    An export with some of the tables only is broken, not absent.
    """
    found, absent = {}, None
    for table, schema in _TABLES.items():
        path = f"{folder}/{table}"
        try:
            found[table] = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(schema).format(kind).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            absent = error
    if found and absent:
        raise FileNotFoundError(f"{folder} has {', '.join(found)} but not all of {', '.join(_TABLES)}")
    if absent:
        raise absent
    return found


def read_opencode_jdbc(spark: SparkSession, url: str, partitions: int = 1, **options: str) -> dict[str, DataFrame]:
    """The three tables over JDBC; the driver jar is the caller's.

    With ``partitions`` above 1 the two large tables are read in slices of
    their creation time, whose bounds are asked for first.
    """
    frames = {}
    for table in _TABLES:
        reader = spark.read.format("jdbc").options(url=url, **options)
        if partitions > 1 and table != "session":
            span = reader.option("query", f"SELECT min(time_created) lo, max(time_created) hi FROM {table}").load()
            low, high = span.first()
            if low is not None and low < high:
                reader = spark.read.format("jdbc").options(
                    url=url, partitionColumn="time_created", lowerBound=str(low), upperBound=str(high),
                    numPartitions=str(partitions), **options,
                )
        frames[table] = reader.option("dbtable", table).load()
    return frames


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Price catalogue documents, one row each in column ``value``."""
    return spark.read.text(path, wholetext=True)


def if_present(read, *args, **kwargs):
    """The frame, or None where the source's path does not exist or holds no file."""
    try:
        frame = read(*args, **kwargs)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    probe = frame["message"] if isinstance(frame, dict) else frame
    return None if probe.limit(1).isEmpty() else frame
