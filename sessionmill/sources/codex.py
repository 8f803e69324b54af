"""codex: JSON Lines in dated folders; session facts sit on their own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import values as V
from sessionmill.operators import pricing as P
from sessionmill.sources.contract import Stage, as_events, as_is, as_messages, join_file_facts

FOLDER = ".codex/sessions"
RAW = "timestamp string, type string, payload string"
_PAYLOAD = (
    "type string, role string, cwd string, model_provider string, model string, "
    "info struct<last_token_usage: string>"
)
# Injected context that is not the user's own text.
CONTEXT_PATTERNS = ("<environment_context>%", "<permissions instructions>%")


def parse(raw: DataFrame) -> DataFrame:
    """The fields events are made of, each document parsed once.  No text is kept."""
    used = F.col("p.info.last_token_usage")
    info = F.get_json_object("payload", "$.info")
    counts = F.from_json("used", "input_tokens string, cached_input_tokens string, output_tokens string")
    parsed = raw.select(
        "filename", "type", V.iso_millis(F.col("timestamp")).alias("ts"), "payload",
        F.from_json("payload", _PAYLOAD).alias("p"),
    ).select(
        "filename", "type", "ts", F.col("p.type").alias("kind"), "p.role", "p.cwd", "p.model_provider", "p.model",
        used.alias("used"),
        # A usage that is present but null counts as one without tokens.
        (used.isNotNull() | F.when(F.col("p.type") == "token_count", V.has_key(info, "last_token_usage"))).alias("reported"),
    )
    return parsed.withColumn("u", counts).select(
        "filename", "type", "ts", "kind", "role", "cwd", "model_provider", "model", "reported",
        V.to_count(F.col("u.input_tokens")).alias("input"),
        V.to_count(F.col("u.cached_input_tokens")).alias("cached"),
        V.to_count(F.col("u.output_tokens")).alias("output"),
    )


def file_facts(parsed: DataFrame) -> DataFrame:
    """Folder, provider and model of a session, from its meta and context rows."""

    def largest(kind: str, field: str) -> Column:
        return F.max(F.when(F.col("type") == kind, F.col(field)))

    return parsed.where("type IN ('session_meta', 'turn_context')").groupBy("filename").agg(
        largest("session_meta", "cwd").alias("session_cwd"),
        largest("session_meta", "model_provider").alias("model_provider"),
        largest("turn_context", "model").alias("model"),
    )


def project() -> Column:
    return F.coalesce(V.last_part(F.col("session_cwd")), F.lit("codex"))


def normalize(raw: DataFrame, prices: DataFrame, stage: Stage = as_is) -> DataFrame:
    return normalize_parsed(stage(parse(raw)), prices)


def normalize_parsed(parsed: DataFrame, prices: DataFrame) -> DataFrame:
    """Messages carry the turn and user flags, usage reports the tokens."""
    usage = "type = 'event_msg' AND kind = 'token_count' AND reported"
    said = "type = 'response_item' AND kind = 'message'"
    rows = parsed.where(f"type IN ('session_meta', 'response_item') OR ({usage})").selectExpr(
        "filename",
        "ts",
        f"if({said} AND role = 'assistant', 1, 0) AS is_turn",
        f"if({said} AND role = 'user', 1, 0) AS is_user",
        f"if({usage}, greatest(input - cached, 0), 0) AS in_tok",
        f"if({usage}, output, 0) AS out_tok",
        f"if({usage}, cached, 0) AS cache_tok",
    )
    rows = join_file_facts(rows, file_facts(parsed))
    rows = P.with_prices(rows, prices, F.col("model"))
    c = F.col
    return as_events(
        rows,
        "codex",
        project=project(),
        provider=F.coalesce(c("model_provider"), c("p_provider"), F.lit("codex")),
        cost=P.usage_cost(c("in_tok"), c("out_tok"), c("cache_tok")),
        **{n: c(n) for n in ("model", "session_cwd", "ts", "in_tok", "out_tok", "cache_tok", "is_turn", "is_user")},
    )


def message_rows(raw: DataFrame) -> DataFrame:
    rows = raw.where(F.col("type") == "response_item").select(
        "filename", V.iso_millis(F.col("timestamp")).alias("ts"), "payload",
        F.from_json("payload", "type string, role string").alias("p"),
    )
    first = F.get_json_object("payload", "$.content[0].text")
    rows = rows.where((F.col("p.type") == "message") & (F.col("p.role") == "user")).select(
        "filename", "ts", first.alias("first"), F.coalesce(first, V.json_text(F.col("payload"), "content")).alias("text")
    )
    own = F.lit(True)
    for pattern in CONTEXT_PATTERNS:
        own = own & ~F.coalesce(F.col("first"), F.lit("")).like(pattern)
    return rows.where(own & F.col("text").isNotNull()).select("filename", "ts", "text")


def message_facts(parsed: DataFrame) -> DataFrame:
    return file_facts(parsed).select("filename", "session_cwd")


def located(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows with the folder and project of their file; a file without meta and context rows has no facts, but a project."""
    return join_file_facts(rows, message_facts(parsed)).withColumn("project", project())


def messages(raw: DataFrame) -> DataFrame:
    return as_messages(located(message_rows(raw), parse(raw)), "codex")
