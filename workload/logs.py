"""Source-shaped raw logs made from ``events``, and a price catalogue made from ``part``.

Every row of ``events`` becomes one raw record per source, so the normalisers
run over the whole table.  A query of several sources deals the table once
(``dealt_rows``) and hands the ``rows`` to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.sources.contract import Stage, as_is
from sessionmill.sources.registry import Prices
from workload.adapter import log_rows, stored, table

STAMP = "date_format(stamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
# Model names of the catalogue; m3 is listed and an alias, m4 is not listed, m5 is an alias only.
LISTED = ("m0", "m1", "m2", "m3", "base-5", "base-3")
ALIASES = (("m5", "base-5"), ("m3", "base-3"))
PROVIDERS = ("groq", "azure", "zeta", "openai", "acme", "google-vertex", "mistral", "beta")


# Terms that the messages of these logs hold: (word, severity, group).
TERMS = [("n", "mild", "letter"), ("7", "strong", "digit"), ("12", "moderate", "dozen"), ("text", "mild", "word"), ("null", "strong", "word")]


def _array(names: tuple[str, ...]) -> str:
    return f"array({', '.join(repr(n) for n in names)})"


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue documents, one per part."""
    return table(spark, sf, "part").selectExpr(
        f"element_at({_array(PROVIDERS)}, int(p_partkey % 8 + 1)) AS provider",
        f"element_at({_array(LISTED)}, int(p_partkey % 6 + 1)) AS model",
        "named_struct('input', p_size / 10D, 'output', double(p_size), 'cache_read', p_size / 100D, "
        "'cache_write', if(p_partkey % 6 < 2, p_size / 5D, NULL)) AS cost",
        "p_name",
    ).selectExpr(
        "to_json(map(provider, named_struct('models', map(model, named_struct('name', p_name, 'cost', cost))))) AS value"
    )


def prices(spark: SparkSession, sf: str, stage: Stage = as_is) -> Prices:
    aliases = spark.createDataFrame(list(ALIASES), "raw_model string, api_model string")
    return Prices.of(catalogue(spark, sf), aliases, stage)


def dealt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows all sources' logs are made of, stored: a filter on a log is not worked out before the rows are dealt."""
    return stored(log_rows(spark, sf, dealt=True))


def _rows(spark: SparkSession, sf: str, rows: DataFrame | None) -> DataFrame:
    return log_rows(spark, sf, dealt=True) if rows is None else rows


def pi(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    role = "CASE WHEN event_type = 'signup' THEN 'user' WHEN event_type IN ('click', 'error') THEN 'toolResult' ELSE 'assistant' END"
    text = "if(k % 2 = 0, to_json(array(named_struct('type', 'text', 'text', concat('n ', k)))), NULL)"
    usage = (
        "if(event_type = 'purchase', named_struct('input', k * 100, 'output', string(k * 10), 'cacheRead', k * 50, "
        "'cost', named_struct('total', CASE WHEN k % 10 = 0 THEN 0D WHEN k % 7 = 0 THEN NULL ELSE value END)), NULL)"
    )
    message = (
        f"to_json(named_struct('role', {role}, 'model', model, 'provider', provider, 'usage', {usage}, "
        "'toolName', if(event_type IN ('click', 'error') AND k % 9 <> 0, tool_name, NULL), "
        "'isError', string(event_type = 'error'), "
        "'content', if(event_type = 'signup', if(k % 2 = 1, concat('n ', k), '@LIST@'), NULL)))"
    )
    # A list as content is spliced in, since one JSON field cannot hold both shapes.
    spliced = f"if(event_type = 'signup' AND k % 2 = 0, replace({message}, '\"@LIST@\"', {text}), {message})"
    return _rows(spark, sf, rows).selectExpr(
        "concat('/logs/--w-', project, '--/', filename, '.jsonl') AS filename",
        "if(k % 11 = 0, 'session', 'message') AS type",
        f"if(k % 13 = 0, NULL, {spliced}) AS message",
        "if(event_id % 5 = 0, concat('/w/', project), NULL) AS cwd",
        f"{STAMP} AS timestamp",
    )


def opencode(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    rows = _rows(spark, sf, rows)
    assistant = (
        "to_json(named_struct('role', 'assistant', 'modelID', model, 'providerID', provider, "
        "'path', named_struct('cwd', if(k % 2 = 0, concat('/o/', project), NULL)), "
        "'cost', CASE WHEN k % 3 = 0 THEN 0D WHEN k % 3 = 1 THEN value END, "
        "'tokens', named_struct('input', k * 100, 'output', k * 10, "
        "'cache', named_struct('read', k * 50, 'write', k * 5))))"
    )
    message = rows.where("event_type IN ('view', 'purchase', 'signup')").selectExpr(
        "concat('g', event_id) AS id", "filename AS session_id", "ms AS time_created",
        f"if(event_type = 'signup', '{{\"role\":\"user\",\"x\":1}}', {assistant}) AS data",
    )
    session = rows.where("user_id % 7 <> 0").selectExpr("filename AS id", "concat('/w/', project) AS directory").distinct()
    part = rows.selectExpr(
        "concat('g', event_id - event_id % 4) AS message_id", "filename AS session_id", "ms AS time_created",
        "if(event_type IN ('click', 'error'), to_json(named_struct('type', 'tool', 'tool', if(k % 9 = 0, NULL, tool_name), "
        "'state', named_struct('status', CASE WHEN event_type = 'click' THEN 'done' WHEN k % 2 = 0 THEN 'error' ELSE 'failed' END))), "
        "to_json(named_struct('type', 'text', 'text', if(k % 6 = 0, NULL, concat('n ', k))))) AS data",
    )
    return {"message": message, "session": session, "part": part}


def claude(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    usage = (
        "named_struct('input_tokens', k * 100, 'output_tokens', k * 10, 'cache_read_input_tokens', k * 50, "
        "'cache_creation_input_tokens', k * 5, 'cache_creation', "
        "named_struct('ephemeral_5m_input_tokens', k, 'ephemeral_1h_input_tokens', k * 2))"
    )
    uses = (
        "to_json(array(named_struct('type', 'text', 'id', NULL, 'name', NULL), "
        "named_struct('type', 'tool_use', 'id', concat('u', k % 10), 'name', tool_name), "
        "named_struct('type', 'server_tool_use', 'id', NULL, 'name', if(k % 2 = 0, 'search', NULL))))"
    )
    answers = (
        "to_json(array(named_struct('type', 'tool_result', 'tool_use_id', concat('u', k % 10), "
        "'is_error', event_type = 'error')))"
    )
    assistant = (
        "concat('{\"role\":\"assistant\",\"model\":', coalesce(to_json(array(model)), 'null'), "
        f"if(k % 2 = 0, concat(',\"usage\":', to_json({usage})), ''), ',\"content\":', "
        f"if(event_type = 'view', {uses}, '\"ok\"'), '}}')"
    )
    # to_json of a one-element array is the quoted name in brackets.
    assistant = assistant.replace("coalesce(to_json(array(model)), 'null')", "concat('\"', model, '\"')")
    user = (
        f"concat('{{\"role\":\"user\",\"content\":', if(event_type = 'signup', "
        f"if(k % 8 = 0, 'null', concat('\"[n ', k, ']\"')), {answers}), '}}')"
    )
    said = "event_type IN ('view', 'purchase')"
    return _rows(spark, sf, rows).selectExpr(
        "concat('/c/', project, '/', filename, '.jsonl') AS filename",
        f"if({said}, 'assistant', 'user') AS type",
        f"{STAMP} AS timestamp",
        "if(event_id % 5 = 0, concat('/w/', project), NULL) AS cwd",
        "concat('a', k % 20) AS uuid",
        "if(k % 5 = 0, NULL, concat('a', (k + 1) % 20)) AS parentUuid",
        "if(k % 10 = 0, concat('a', k % 20), NULL) AS sourceToolAssistantUUID",
        "string(k % 17 = 0) AS isMeta",
        f"if({said}, {assistant}, {user}) AS message",
        "if(event_type = 'error' AND k % 4 = 0, to_json(named_struct('tool_use_id', concat('u', (k + 1) % 10), 'is_error', 'true')), NULL) AS toolUseResult",
        f"if({said} AND k % 2 = 1, to_json({usage}), NULL) AS usage",
        "if(event_type = 'purchase' AND k % 3 = 0, string(value), NULL) AS costUSD",
    )


def codex(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    counts = "named_struct('input_tokens', k * 10, 'cached_input_tokens', 300, 'output_tokens', k)"
    payloads = {
        "signup": "named_struct('cwd', concat('/w/', project), 'model_provider', provider)",
        "view": "named_struct('model', model, 'cwd', 'elsewhere')",
        "click": "named_struct('type', 'message', 'role', if(k % 2 = 0, 'user', 'assistant'), "
        "'content', array(named_struct('text', concat(CASE WHEN k % 8 = 0 THEN '<environment_context>' "
        "WHEN k % 8 = 2 THEN '<permissions instructions>' ELSE '' END, 'n ', k))))",
        "purchase": f"named_struct('type', 'token_count', 'info', if(k % 4 = 0, NULL, named_struct('last_token_usage', {counts})))",
        "error": "named_struct('type', 'agent_message')",
    }
    payload = " ".join(f"WHEN '{kind}' THEN to_json({body})" for kind, body in payloads.items())
    return _rows(spark, sf, rows).selectExpr(
        "concat('/x/', filename, '.jsonl') AS filename",
        f"{STAMP} AS timestamp",
        "CASE event_type WHEN 'signup' THEN 'session_meta' WHEN 'view' THEN 'turn_context' "
        "WHEN 'click' THEN 'response_item' ELSE 'event_msg' END AS type",
        f"CASE event_type {payload} END AS payload",
    )


def gemini(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One small chat document per event: a question and an answer with tool calls."""
    question = f"to_json(named_struct('type', 'user', 'timestamp', {STAMP}, 'content', concat('n ', k)))"
    answer = (
        f"to_json(named_struct('type', if(k % 12 = 0, 'info', 'gemini'), 'model', model, 'timestamp', {STAMP}, "
        "'tokens', named_struct('input', k * 100, 'output', k * 10, 'cached', k * 50), "
        "'toolCalls', if(event_type IN ('click', 'error'), array("
        f"named_struct('name', tool_name, 'status', if(event_type = 'error', 'error', 'success'), 'timestamp', {STAMP}), "
        f"named_struct('name', if(k % 2 = 0, 'shell', NULL), 'status', 'success', 'timestamp', {STAMP})), NULL)))"
    )
    return _rows(spark, sf, rows).selectExpr(
        "concat('/g/', project, '/chats/', filename, '.json') AS filename", f"array({question}, {answer}) AS messages"
    )
