"""opencode: three relational tables, message, session and part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import values as V
from sessionmill.operators import pricing as P
from sessionmill.operators.skew import join_facts
from sessionmill.sources.contract import as_events, as_messages

MESSAGE = "id string, session_id string, time_created bigint, data string"
SESSION = "id string, directory string"
PART = "message_id string, session_id string, time_created bigint, data string"
_ASSISTANT = (
    "modelID string, providerID string, cost string, path struct<cwd: string>, "
    "tokens struct<input: string, output: string, cache: struct<read: string, write: string>>"
)


def _is_role(role: str) -> Column:
    return F.col("data").startswith('{"role":"%s"' % role)


def _project(cwd: Column) -> Column:
    return F.coalesce(V.last_part(cwd), F.lit("opencode"))


def _directories(session: DataFrame) -> DataFrame:
    return session.select(F.col("id").alias("filename"), "directory")


def _provider() -> Column:
    return F.coalesce(F.col("providerID"), F.col("p_provider"), F.lit("opencode"))


def normalize_assistant(
    message: DataFrame, session: DataFrame, prices: DataFrame
) -> DataFrame:
    parsed = message.where(_is_role("assistant")).select(
        F.col("session_id").cast("string").alias("filename"),
        F.col("time_created").cast("bigint").alias("ts"),
        F.from_json("data", _ASSISTANT).alias("d"),
    )
    rows = parsed.select(
        "filename",
        "ts",
        "d.modelID",
        "d.providerID",
        F.col("d.path.cwd").alias("own_cwd"),
        V.to_double(F.col("d.cost")).alias("recorded"),
        V.to_count(F.col("d.tokens.input")).alias("fresh_tok"),
        V.to_count(F.col("d.tokens.cache.write")).alias("write_tok"),
        V.to_count(F.col("d.tokens.output")).alias("out_tok"),
        V.to_count(F.col("d.tokens.cache.read")).alias("cache_tok"),
    )
    rows = join_facts(P.with_prices(rows, prices, F.col("modelID")), _directories(session), ["filename"])
    c = F.col
    cwd = F.coalesce(c("own_cwd"), c("directory"))
    priced = P.usage_cost(c("fresh_tok"), c("out_tok"), c("cache_tok"), c("write_tok"))
    return as_events(
        rows,
        "opencode",
        project=_project(cwd),
        model=c("modelID"),
        provider=_provider(),
        session_cwd=cwd,
        ts=c("ts"),
        cost=P.recorded_or(c("recorded"), priced),
        in_tok=c("fresh_tok") + c("write_tok"),
        out_tok=c("out_tok"),
        cache_tok=c("cache_tok"),
        is_turn=F.lit(1),
    )


def _user_rows(message: DataFrame, session: DataFrame) -> DataFrame:
    users = message.where(_is_role("user")).select(
        F.col("id").alias("message_id"),
        F.col("session_id").cast("string").alias("filename"),
        F.col("time_created").cast("bigint").alias("ts"),
    )
    return join_facts(users, _directories(session), ["filename"], "inner")


def normalize_user(message: DataFrame, session: DataFrame) -> DataFrame:
    directory = F.col("directory")
    return as_events(
        _user_rows(message, session),
        "opencode",
        project=_project(directory),
        session_cwd=directory,
        ts=F.col("ts"),
        is_user=F.lit(1),
    )


def normalize_tool(
    part: DataFrame, message: DataFrame, session: DataFrame, prices: DataFrame
) -> DataFrame:
    calls = (
        part.where(F.col("data").startswith('{"type":"tool"'))
        .select(
            "message_id",
            F.col("session_id").cast("string").alias("filename"),
            F.col("time_created").cast("bigint").alias("ts"),
            F.from_json("data", "tool string, state struct<status: string>").alias("d"),
        )
        .where(F.col("d.tool").isNotNull())
        .select("message_id", "filename", "ts", "d.tool", F.col("d.state.status").alias("status"))
    )
    # Parsed before the join: only three short fields are shuffled, not the document.
    callers = message.select(
        F.col("id").alias("message_id"),
        F.from_json("data", "modelID string, providerID string, path struct<cwd: string>").alias("d"),
    ).select("message_id", "d.modelID", "d.providerID", F.col("d.path.cwd").alias("own_cwd"))
    rows = join_facts(calls, callers, ["message_id"], "inner")
    rows = join_facts(rows, _directories(session), ["filename"])
    rows = P.with_prices(rows, prices, F.col("modelID"))
    cwd = F.coalesce(F.col("own_cwd"), F.col("directory"))
    return as_events(
        rows,
        "opencode",
        project=_project(cwd),
        model=F.col("modelID"),
        provider=_provider(),
        session_cwd=cwd,
        ts=F.col("ts"),
        is_tool=F.lit(1),
        is_error=V.flag(F.col("status").isin("error", "failed")),
        tool=F.col("tool"),
    )


def normalize(raw: dict[str, DataFrame], prices: DataFrame) -> DataFrame:
    """All events; the tables are relational already, so there is nothing to parse ahead."""
    message, session, part = raw["message"], raw["session"], raw["part"]
    return (
        normalize_assistant(message, session, prices)
        .unionByName(normalize_user(message, session))
        .unionByName(normalize_tool(part, message, session, prices))
    )


def message_rows(raw: dict[str, DataFrame]) -> DataFrame:
    """User texts keyed by message, before message and session are joined."""
    return (
        raw["part"]
        .select("message_id", F.from_json("data", "type string, text string").alias("d"))
        .where((F.col("d.type") == "text") & F.col("d.text").isNotNull())
        .select("message_id", "d.text")
    )


def message_facts(raw: dict[str, DataFrame]) -> DataFrame:
    users = _user_rows(raw["message"], raw["session"])
    directory = F.col("directory")
    return users.select(
        "message_id", "filename", "ts", _project(directory).alias("project"), directory.alias("session_cwd")
    )


def messages(raw: dict[str, DataFrame]) -> DataFrame:
    return as_messages(join_facts(message_rows(raw), message_facts(raw), ["message_id"], "inner"), "opencode")
