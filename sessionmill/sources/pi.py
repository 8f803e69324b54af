"""pi: JSON Lines, one file per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import values as V
from sessionmill.operators import pricing as P
from sessionmill.sources.contract import Stage, as_events, as_is, as_messages, join_file_facts

GLOB = ".pi/agent/sessions/*/*.jsonl"
RAW = "type string, message string, cwd string, timestamp string"
_MESSAGE = (
    "role string, model string, provider string, toolName string, isError string, "
    "usage struct<input: string, output: string, cacheRead: string, cost: struct<total: string>>"
)


def parse(raw: DataFrame) -> DataFrame:
    """The fields events are made of; no text but whether there is one."""
    kept = raw.where("message IS NOT NULL OR type = 'session'")
    return kept.select(
        "filename", "cwd", V.iso_millis(F.col("timestamp")).alias("ts"), F.from_json("message", _MESSAGE).alias("m"),
        V.json_text(F.col("message"), "content").isNotNull().alias("has_text"),
    ).select(
        "filename",
        "cwd",
        "ts",
        "m.role",
        "m.model",
        "m.provider",
        F.col("m.toolName").alias("tool"),
        V.is_true(F.col("m.isError")).alias("failed"),
        V.to_double(F.col("m.usage.cost.total")).alias("recorded"),
        V.to_count(F.col("m.usage.input")).alias("in_tok"),
        V.to_count(F.col("m.usage.output")).alias("out_tok"),
        V.to_count(F.col("m.usage.cacheRead")).alias("cache_tok"),
        "has_text",
    )


def _projects(rows: DataFrame) -> DataFrame:
    """Per file the last part of its session folder, else the name coded in the log's folder."""
    coded = F.split_part(V.part_from_end(F.col("filename"), 2), F.lit("--"), F.lit(2))
    project = F.coalesce(V.last_part(F.col("cwd")), coded).alias("project")
    return rows.groupBy("filename").agg(F.max("cwd").alias("cwd")).select("filename", project)


def normalize(raw: DataFrame, prices: DataFrame, stage: Stage = as_is) -> DataFrame:
    return normalize_parsed(stage(parse(raw)), prices)


def normalize_parsed(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    rows = join_file_facts(P.with_prices(parsed, prices, F.col("model")), _projects(parsed))
    c = F.col
    result = c("role") == "toolResult"
    return as_events(
        rows,
        "pi",
        project=c("project"),
        model=c("model"),
        provider=F.coalesce(c("provider"), F.lit("unknown")),
        session_cwd=c("cwd"),
        ts=c("ts"),
        # Cache writes are not among the counts read here, so they carry no price.
        cost=P.recorded_or(c("recorded"), P.usage_cost(c("in_tok"), c("out_tok"), c("cache_tok"))),
        in_tok=c("in_tok"),
        out_tok=c("out_tok"),
        cache_tok=c("cache_tok"),
        is_turn=V.flag(c("role") == "assistant"),
        is_user=V.flag(c("role") == "user"),
        is_tool=V.flag(result & c("tool").isNotNull()),
        is_error=V.flag(result & c("failed")),
        tool=c("tool"),
    )


def message_rows(raw: DataFrame) -> DataFrame:
    """User texts before the file facts are joined."""
    return raw.where(F.get_json_object("message", "$.role") == "user").select(
        "filename",
        F.col("cwd").alias("session_cwd"),
        V.iso_millis(F.col("timestamp")).alias("ts"),
        V.json_text(F.col("message"), "content").alias("text"),
    )


def message_facts(parsed: DataFrame) -> DataFrame:
    """Projects as the user rows alone tell them."""
    return _projects(parsed.where("role = 'user' AND has_text"))


def messages(raw: DataFrame) -> DataFrame:
    return as_messages(join_file_facts(message_rows(raw), message_facts(parse(raw))), "pi")
