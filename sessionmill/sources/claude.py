"""claude: JSON Lines under project folders, read recursively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import values as V
from sessionmill.operators import pricing as P
from sessionmill.operators.skew import join_facts
from sessionmill.sources.contract import Stage, as_events, as_is, as_messages, join_file_facts

FOLDER = ".claude/projects"
# Booleans and numbers are read as text and cast leniently later.
RAW = (
    "type string, timestamp string, cwd string, sessionId string, uuid string, parentUuid string, "
    "sourceToolAssistantUUID string, isSidechain string, isMeta string, message string, toolUseResult string, "
    "usage string, costUSD string"
)
_USAGE = (
    "struct<input_tokens: string, output_tokens: string, cache_read_input_tokens: string, "
    "cache_creation_input_tokens: string, "
    "cache_creation: struct<ephemeral_5m_input_tokens: string, ephemeral_1h_input_tokens: string>>"
)
# ``content`` is an array only when the JSON value is one; a string stays NULL
# even if its text looks like an array.  Elements keep their JSON text.
_MESSAGE = f"role string, model string, content array<string>, usage {_USAGE}"
_ITEM = "type string, id string, name string, tool_use_id string, is_error string"
_TOKENS = {
    "fresh_tok": ("input_tokens",),
    # The cache-creation total and its split by lifetime are added up, as recorded.
    "write_tok": (
        "cache_creation_input_tokens",
        "cache_creation.ephemeral_5m_input_tokens",
        "cache_creation.ephemeral_1h_input_tokens",
    ),
    "out_tok": ("output_tokens",),
    "cache_tok": ("cache_read_input_tokens",),
}
PROVIDER = "anthropic"


def parse(raw: DataFrame) -> DataFrame:
    """The fields events are made of, each document parsed once.  No text is kept.

    ``said`` marks user records that are neither meta nor a bundle of tool
    results; a record without any content is none either.
    """
    parsed = raw.select(
        "filename", "type", "timestamp", "cwd", "uuid", V.iso_millis(F.col("timestamp")).alias("ts"),
        F.coalesce("sourceToolAssistantUUID", "parentUuid").alias("answers"),
        V.to_double(F.col("costUSD")).alias("recorded"),
        V.is_true(F.col("isMeta")).alias("meta"),
        F.from_json("message", _MESSAGE).alias("m"),
        F.from_json("usage", _USAGE).alias("u"),
        F.from_json("toolUseResult", "tool_use_id string, is_error string").alias("direct"),
        F.when(F.col("type") == "user", V.json_text(F.col("message"), "content")).alias("text"),
        F.col("toolUseResult").isNotNull().alias("has_direct"),
    )

    def tokens(fields: tuple[str, ...]) -> Column:
        counts = [V.to_count(F.coalesce(F.col(f"m.usage.{f}"), F.col(f"u.{f}"))) for f in fields]
        return reduce(Column.__add__, counts)

    bundle = F.col("m.content").isNotNull() & F.col("text").contains('"tool_result"')
    return parsed.select(
        "filename", "type", "timestamp", "cwd", "uuid", "ts", "answers", "recorded", "m.role", "m.model",
        *[tokens(fields).alias(name) for name, fields in _TOKENS.items()],
        F.coalesce((F.col("type") == "user") & ~F.col("meta") & F.col("text").isNotNull() & ~bundle, F.lit(False))
        .alias("said"),
        F.transform("m.content", lambda json: F.from_json(json, _ITEM)).alias("items"),
        F.when(F.col("has_direct"), F.struct("direct.tool_use_id", "direct.is_error")).alias("direct"),
    )


def file_facts(rows: DataFrame) -> DataFrame:
    """Folder and project of a file; ``rows`` may be raw or parsed."""
    cwd = F.max("cwd").alias("session_cwd")
    project = F.coalesce(
        V.last_part(F.col("session_cwd")), V.part_from_end(F.col("filename"), 2), F.lit("claude")
    )
    return rows.groupBy("filename").agg(cwd).select("filename", "session_cwd", project.alias("project"))


def _assistant(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    c = F.col
    priced = P.usage_cost(c("fresh_tok"), c("out_tok"), c("cache_tok"), c("write_tok"))
    turns = parsed.where("type = 'assistant' AND role = 'assistant'")
    return P.with_prices(turns, prices, c("model")).select(
        "filename", "ts", "model",
        F.coalesce(c("recorded"), priced).alias("cost"),
        (c("fresh_tok") + c("write_tok")).alias("in_tok"), "out_tok", "cache_tok",
        F.lit(1).alias("is_turn"),
    )


def _is_kind(suffix: str) -> Column:
    kind = F.col("item.type")
    return (kind == suffix) | kind.like(f"%_{suffix}")


def tool_uses(parsed: DataFrame) -> DataFrame:
    items = parsed.where("type = 'assistant'").select(
        "filename", "timestamp", "ts", "model", "uuid", F.explode("items").alias("item")
    )
    return items.where(_is_kind("tool_use")).select(
        "filename", "timestamp", "ts", "model", "uuid",
        F.col("item.id").alias("use_id"),
        F.coalesce("item.name", "item.type", F.lit("tool")).alias("tool"),
    )


def tool_results(parsed: DataFrame) -> DataFrame:
    """Results from content items and from the record itself: which use, and did it fail."""
    listed = F.filter(
        "items", lambda item: (item["type"] == "tool_result") | item["type"].like("%_tool_result")
    )
    found = F.transform(listed, lambda item: F.struct(item["tool_use_id"], item["is_error"]))
    direct = F.when(F.col("direct").isNotNull(), F.array("direct")).otherwise(F.array())
    none = F.array().cast("array<struct<tool_use_id: string, is_error: string>>")
    every = F.concat(F.coalesce(found, none), F.coalesce(direct, none))
    rows = parsed.where("type = 'user'").select("filename", F.col("answers").alias("uuid"), F.explode(every).alias("result"))
    return rows.select(
        "filename", F.col("result.tool_use_id").alias("use_id"), "uuid", V.is_true(F.col("result.is_error")).alias("failed")
    )


def judge_tool_uses(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct tool uses with ``is_error`` 1 if a failed result names their id or their record.

    "Same id or same record" is two equality joins: the only thing asked of the
    matches is whether one failed, so failures are reduced to one row per id
    and one per record before they are joined.
    """
    failed = results.where("failed")
    by_id = failed.where("use_id IS NOT NULL").select("filename", F.col("use_id").alias("_id")).distinct()
    by_record = failed.where("uuid IS NOT NULL").select("filename", F.col("uuid").alias("_uuid")).distinct()

    def never(column: str) -> Column:
        """NULL never matches; give it a value of its own so that NULLs do not share a partition."""
        own = F.concat(F.lit("\u0000"), F.xxhash64(*uses.columns).cast("string"))
        return F.coalesce(F.col(column), own)

    distinct = uses.distinct().withColumns({"_id": never("use_id"), "_uuid": never("uuid")})
    found = join_facts(distinct, by_id.withColumn("_hit_id", F.lit(1)), ["filename", "_id"])
    found = join_facts(found, by_record.withColumn("_hit_uuid", F.lit(1)), ["filename", "_uuid"])
    return found.select(*uses.columns, F.coalesce("_hit_id", "_hit_uuid", F.lit(0)).alias("is_error"))


def _tool_calls(parsed: DataFrame) -> DataFrame:
    judged = judge_tool_uses(tool_uses(parsed), tool_results(parsed))
    return judged.select("filename", "ts", "model", "tool", "is_error", F.lit(1).alias("is_tool"))


def normalize(raw: DataFrame, prices: DataFrame, stage: Stage = as_is) -> DataFrame:
    return normalize_parsed(stage(parse(raw)), prices)


def normalize_parsed(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    users = parsed.where("said").select("filename", "ts", F.lit(1).alias("is_user"))
    rows = (
        _assistant(parsed, prices)
        .unionByName(users, allowMissingColumns=True)
        .unionByName(_tool_calls(parsed), allowMissingColumns=True)
    )
    numbers = ("cost", "in_tok", "out_tok", "cache_tok", "is_turn", "is_user", "is_tool", "is_error")
    return as_events(
        join_file_facts(rows, file_facts(parsed)),
        "claude",
        provider=F.lit(PROVIDER),
        **{c: F.col(c) for c in ("project", "model", "session_cwd", "ts", "tool")},
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in numbers},
    )


def message_rows(raw: DataFrame) -> DataFrame:
    """What the user said; the same records as ``said`` in ``parse``, with their text."""
    parsed = raw.where((F.col("type") == "user") & ~V.is_true(F.col("isMeta"))).select(
        "filename", V.iso_millis(F.col("timestamp")).alias("ts"),
        V.json_text(F.col("message"), "content").alias("text"),
        F.from_json("message", "content array<string>").getField("content").isNotNull().alias("is_list"),
    )
    said = parsed.where("text IS NOT NULL AND NOT (is_list AND contains(text, '\"tool_result\"'))")
    return said.select("filename", "ts", "text")


def message_facts(parsed: DataFrame) -> DataFrame:
    return file_facts(parsed)


def messages(raw: DataFrame) -> DataFrame:
    return as_messages(join_file_facts(message_rows(raw), file_facts(raw)), "claude")
