"""gemini: one JSON document per chat, with a ``messages`` array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import values as V
from sessionmill.operators import pricing as P
from sessionmill.sources.contract import Stage, as_events, as_is, as_messages

GLOB = ".gemini/tmp/*/chats/*.json"
# Elements keep their JSON text; a value that is no array reads as NULL.
RAW = "messages array<string>"
_MESSAGE = (
    "type string, model string, timestamp string, "
    "tokens struct<input: string, output: string, cached: string>, toolCalls array<string>"
)


def _project() -> Column:
    return F.coalesce(V.part_from_end(F.col("filename"), 3), F.lit("gemini"))


def _provider() -> Column:
    return F.coalesce(F.col("p_provider"), F.lit("google"))


def parse(raw: DataFrame) -> DataFrame:
    """One row per chat message with its tool calls, each document parsed once.  No text is kept."""
    rows = raw.select("filename", F.explode("messages").alias("json")).select(
        "filename", F.from_json("json", _MESSAGE).alias("m")
    )
    call = "name string, status string, timestamp string"
    return rows.select(
        "filename",
        V.iso_millis(F.col("m.timestamp")).alias("ts"),
        "m.type",
        "m.model",
        V.to_count(F.col("m.tokens.input")).alias("in_tok"),
        V.to_count(F.col("m.tokens.output")).alias("out_tok"),
        V.to_count(F.col("m.tokens.cached")).alias("cache_tok"),
        F.transform("m.toolCalls", lambda json: F.from_json(json, call)).alias("calls"),
    )


def normalize_messages(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    """Chat messages.  ``prices`` is the catalogue without the alias overlay."""
    rows = P.with_prices(parsed.where("type IN ('user', 'gemini')"), prices, F.col("model"))
    c = F.col
    return as_events(
        rows,
        "gemini",
        project=_project(),
        model=c("model"),
        provider=_provider(),
        cost=P.usage_cost(c("in_tok"), c("out_tok"), c("cache_tok")),
        is_turn=V.flag(c("type") == "gemini"),
        is_user=V.flag(c("type") == "user"),
        **{n: c(n) for n in ("ts", "in_tok", "out_tok", "cache_tok")},
    )


def normalize_tools(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    """Tool calls nested in the messages, each with a time of its own."""
    calls = parsed.select("filename", "model", F.explode("calls").alias("t")).where("t.name IS NOT NULL")
    return as_events(
        P.with_prices(calls, prices, F.col("model")),
        "gemini",
        project=_project(),
        model=F.col("model"),
        provider=_provider(),
        ts=V.iso_millis(F.col("t.timestamp")),
        is_tool=F.lit(1),
        is_error=V.flag(F.col("t.status") == "error"),
        tool=F.col("t.name"),
    )


def normalize(raw: DataFrame, prices: DataFrame, stage: Stage = as_is) -> DataFrame:
    return normalize_parsed(stage(parse(raw)), prices)


def normalize_parsed(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    return normalize_messages(parsed, prices).unionByName(normalize_tools(parsed, prices))


def message_rows(raw: DataFrame) -> DataFrame:
    parsed = raw.select("filename", F.explode("messages").alias("json")).select(
        "filename", "json", F.from_json("json", "type string, timestamp string").alias("m")
    )
    return parsed.where(F.col("m.type") == "user").select(
        "filename",
        V.iso_millis(F.col("m.timestamp")).alias("ts"),
        V.json_text(F.col("json"), "content").alias("text"),
        _project().alias("project"),
        F.lit(None).cast("string").alias("session_cwd"),
    )


def messages(raw: DataFrame) -> DataFrame:
    return as_messages(message_rows(raw), "gemini")
