"""The test tables seen as session logs.

``events`` becomes unified events, ``conversations`` becomes messages and
turns.  The expressions are mirrored, in SQL, in ``oracle.py``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.values import ntz_millis
from sessionmill.operators import detect
from sessionmill.plans.store import Rollups
from sessionmill.schemas import EVENT, HARNESSES

c = F.col

# Words that do occur in the test texts, as (word, severity, group).
LEXICON = [
    ("the", "mild", "article"),
    ("der", "mild", "article"),
    ("die", "moderate", "article"),
    ("la", "mild", "article"),
    ("of", "strong", "of"),
    ("and", "moderate", "and"),
    ("que", "strong", "que"),
    ("un", "moderate", "article"),
]

# Terms of several words, with symbols and accents; some are part of others.
PHRASES = [
    ("the", "mild", "article"), ("the the", "strong", "twice"), ("of", "mild", "of"), ("de la", "moderate", "article"), ("für", "mild", "für"),
    ("ción", "moderate", "end"), ("example.com", "strong", "site"), ("by-nc", "moderate", "licence"), ("é", "mild", "letter"), ("cc by-nc", "strong", "licence"),
]
# Entries that make a dictionary large: term0, term1 and so on.
FILLERS = 100_000


def large_lexicon(spark: SparkSession) -> DataFrame:
    known = spark.createDataFrame(PHRASES, "word string, severity string, group string")
    return known.unionByName(spark.range(FILLERS).selectExpr("concat('term', id) AS word", "'mild' AS severity", "'filler' AS group"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """The frame written below ``spark.checkpoint.dir`` and read back: later steps start from files, as in a refresh.

    A local session that names no such folder writes to a temporary one.
    """
    spark = frame.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sessionmill-")
    path = f"{root.rstrip('/')}/workload-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def log_rows(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """``events`` with the values the adapters and the source-shaped logs are made of.

    ``dealt`` puts them into partitions by event, as logs come in many files where the table here is one.
    """
    named = "event_type <> 'signup'"
    pick = "(user_id + event_id) % 6"
    harnesses = ", ".join(f"'{h}'" for h in HARNESSES)
    events = table(spark, sf, "events")
    return (events.repartition("event_id") if dealt else events).select(
        "event_id", "event_type", "user_id", "value",
        c("ts").alias("stamp"),
        ntz_millis(c("ts")).alias("ms"),
        *[
            F.expr(f"{text} AS {name}")
            for name, text in {
                "k": "bigint(get_json_object(props, '$.k'))",
                "harness": f"element_at(array({harnesses}), int(user_id % 5 + 1))",
                "filename": "concat('s', user_id, '-', floor((dayofmonth(ts) - 1) / 7))",
                "project": "concat('p', user_id % 12)",
                "model": f"if({named}, concat('m', {pick}), NULL)",
                "provider": f"if({named} AND {pick} <> 5, concat('v', {pick} % 3), NULL)",
                "tool_name": "concat('t', event_id % 9)",
            }.items()
        ],
    )


def _as_events(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.selectExpr(
        *[f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in EVENT.fields]
    )


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Unified events from ``events``."""

    def bought(value: str) -> str:
        return f"if(event_type = 'purchase', {value}, 0)"

    is_tool = "event_type IN ('click', 'error')"
    return _as_events(log_rows(spark, sf), {
        **{name: name for name in ("harness", "filename", "project", "model", "provider")},
        "raw_model": "model",
        "session_cwd": "concat('/w/', project)",
        "ts": "ms",
        "cost": bought("if(k % 10 = 0, 0, value)"),
        "in_tok": bought("k * 100"),
        "out_tok": bought("k * 10"),
        "cache_tok": bought("k * 50"),
        "is_turn": "event_type = 'view'",
        "is_user": "event_type = 'signup'",
        "is_tool": is_tool,
        "is_error": "event_type = 'error'",
        "tool": f"if({is_tool}, tool_name, NULL)",
    })


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns of ``conversations`` as unified events; user rows as user events."""
    said = table(spark, sf, "conversations").where("role IN ('assistant', 'user')")
    replied = "role = 'assistant'"
    model = f"if({replied}, concat('m', conv_id % 4), NULL)"
    return _as_events(said, {
        "harness": "'pi'",
        "filename": "concat('c', conv_id)",
        "project": "concat('p', conv_id % 12)",
        "raw_model": model,
        "model": model,
        "provider": f"if({replied} AND conv_id % 4 <> 3, concat('v', conv_id % 2), NULL)",
        "ts": "(turn + 1) * 1000",
        "is_turn": replied,
        "is_user": f"NOT ({replied})",
        **{name: "0" for name in ("is_tool", "is_error", "cost", "in_tok", "out_tok", "cache_tok")},
    })


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """User messages of ``conversations``."""
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.selectExpr(
        "'pi' AS harness",
        "concat('c', conv_id) AS filename",
        "concat('p', conv_id % 12) AS project",
        "CAST(NULL AS STRING) AS session_cwd",
        "(turn + 1) * 1000 AS ts",
        "text",
    )


def chat_hits(spark: SparkSession, sf: str) -> DataFrame:
    return detect.as_hits(detect.detect(chat_messages(spark, sf), LEXICON))


def event_rollups(spark: SparkSession, sf: str) -> Rollups:
    """Rollups of ``events`` alone, without term hits."""
    return Rollups(event_rows(spark, sf))


def all_rollups(spark: SparkSession, sf: str) -> Rollups:
    """Rollups of ``events`` and ``conversations`` together, with the term hits of the latter."""
    return Rollups(event_rows(spark, sf).unionByName(chat_turns(spark, sf)), chat_hits(spark, sf))
