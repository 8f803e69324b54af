"""Contracts between the layers."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _columns(listed: str) -> T.StructType:
    """'name kind, ...' as a schema; unlike DDL parsing this needs no session."""
    pairs = [column.split() for column in listed.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


EVENT = _columns(
    "harness string, filename string, project string, raw_model string, model string, provider string, "
    "session_cwd string, ts bigint, cost double, in_tok bigint, out_tok bigint, cache_tok bigint, "
    "is_turn int, is_user int, is_tool int, is_error int, tool string"
)
MESSAGE = _columns(
    "harness string, filename string, project string, session_cwd string, ts bigint, text string"
)
HIT = _columns(
    "hit_id bigint, harness string, filename string, project string, ts bigint, "
    "word string, group_name string, severity string"
)
ATTRIBUTED_HIT = T.StructType(HIT.fields + _columns("model string, provider string").fields)
PRICING = _columns(
    "model string, provider string, friendly_name string, "
    "input_cost double, output_cost double, cache_cost double, cache_write_cost double"
)
LEXICON = _columns("word string, severity string, group string")

SESSION_KEY = ["harness", "filename"]
USAGE_KEY = [*SESSION_KEY, "model", "provider"]
HARNESSES = ("pi", "opencode", "claude", "codex", "gemini")
