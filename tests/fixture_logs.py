"""A small home folder with logs of all five sources, written by hand."""

from __future__ import annotations

import json
import os

CATALOGUE = {
    "openai": {"models": {"gpt-x": {"name": "X", "cost": {"input": 2, "output": 8, "cache_read": 0.5}}}},
    "azure": {"models": {"gpt-x": {"name": "X on A", "cost": {"input": 3, "output": 8}}}},
    "anthropic": {
        "models": {"sonnet": {"name": "S", "cost": {"input": 3, "output": 15, "cache_read": 0.3, "cache_write": 3.75}}}
    },
    "zeta": {"models": {"kimi-k2.6": {"name": "K", "cost": {"input": 1, "output": 4}}, "free": {"name": "F"}}},
    "empty": {},
}


def T(second: int) -> str:
    return f"2025-03-04T10:00:{second:02d}.500Z"


def MS(second: int) -> int:
    return 1741082400500 + second * 1000


PI = [
    {"type": "session", "cwd": "/home/u/shop", "timestamp": T(0)},
    {"type": "message", "timestamp": T(1), "message": {"role": "user", "content": "what the hell, helllo shit"}},
    {"type": "message", "timestamp": T(2), "message": {
        "role": "assistant", "model": "gpt-x", "provider": "openai",
        "usage": {"input": 1000, "output": 100, "cacheRead": "10", "cost": {"total": 0}}}},
    {"type": "message", "timestamp": T(3), "message": {"role": "toolResult", "toolName": "bash", "isError": True}},
    {"type": "message", "timestamp": T(4), "message": {"role": "toolResult", "isError": False}},
    {"type": "message", "timestamp": T(5), "message": {
        "role": "assistant", "model": "accounts/fireworks/models/kimi-k2p6",
        "usage": {"input": "12.7", "output": 1, "cost": {"total": 0.25}}}},
    {"type": "message", "timestamp": "no time", "message": {"role": "user", "content": [{"type": "text", "text": "damn"}]}},
    {"type": "other", "cwd": "/zzz"},
    "this line is broken",
]
CLAUDE = [
    {"type": "user", "timestamp": T(0), "cwd": "/w/app", "uuid": "r0", "message": {"role": "user", "content": "[not a list]"}},
    {"type": "assistant", "timestamp": T(1), "uuid": "r1", "message": {
        "role": "assistant", "model": "sonnet",
        "usage": {"input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 4,
                  "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 1}},
        "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t1", "name": "Read"},
                    {"type": "tool_use", "id": "t2", "name": "Bash"}, {"type": "server_tool_use", "id": "t3"}]}},
    # Failed by id only.
    {"type": "user", "timestamp": T(2), "uuid": "r2", "message": {
        "role": "user", "content": [{"type": "tool_result", "tool_use_id": "t2", "is_error": True}]}},
    # Named by record only, not failed.
    {"type": "user", "timestamp": T(3), "parentUuid": "r1", "toolUseResult": {"is_error": False}, "message": {
        "role": "user", "content": [{"type": "tool_result", "tool_use_id": "t9"}]}},
    {"type": "assistant", "timestamp": T(4), "uuid": "r4", "costUSD": 1.5, "message": {
        "role": "assistant", "model": "sonnet", "content": [{"type": "tool_use", "id": "t4", "name": "Edit"}]},
        "usage": {"input_tokens": 7}},
    # Failed by the record it answers.
    {"type": "user", "timestamp": T(5), "sourceToolAssistantUUID": "r4", "parentUuid": "r1",
     "toolUseResult": {"tool_use_id": None, "is_error": "true"}, "message": {"role": "user", "content": None}},
    {"type": "user", "timestamp": T(6), "isMeta": True, "message": {"role": "user", "content": "meta shit"}},
    {"type": "user", "timestamp": T(7), "message": {"role": "user"}},
    {"type": "user", "timestamp": T(8), "message": {"role": "user", "content": "wtf"}},
]
CODEX = [
    {"timestamp": T(0), "type": "session_meta", "payload": {"cwd": "/src/lib", "model_provider": None}},
    {"timestamp": T(0), "type": "turn_context", "payload": {"model": "gpt-x"}},
    {"timestamp": T(1), "type": "response_item", "payload": {
        "type": "message", "role": "user", "content": [{"text": "<environment_context> shit"}]}},
    {"timestamp": T(2), "type": "response_item", "payload": {
        "type": "message", "role": "user", "content": [{"text": "crap"}]}},
    {"timestamp": T(3), "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}},
    {"timestamp": T(4), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {
        "input_tokens": 100, "cached_input_tokens": 140, "output_tokens": 10}}}},
    {"timestamp": T(5), "type": "event_msg", "payload": {"type": "token_count", "info": None}},
]
GEMINI = {"messages": [
    {"type": "user", "timestamp": T(1), "content": "stfu"},
    {"type": "gemini", "model": "free", "timestamp": T(2), "tokens": {"input": 5, "output": 6, "cached": 7},
     "toolCalls": [{"name": "ls", "status": "error", "timestamp": T(3)}, {"status": "success"}]},
    {"type": "info", "timestamp": T(4)},
]}
# (id, session, time, data) as the tool itself writes it, role or type first.
MESSAGE = [
    ("m1", "s1", MS(0), '{"role":"user"}'),
    ("m2", "s1", MS(1), '{"role":"assistant","modelID":"sonnet","providerID":null,"path":{"cwd":"/k/own"},"cost":0,'
                        '"tokens":{"input":100,"output":10,"cache":{"read":5,"write":2}}}'),
    ("m3", "s2", MS(2), '{"role":"assistant","modelID":"unknown-model","cost":0.5,"tokens":{"input":1,"output":1}}'),
    ("m4", "s2", MS(3), '{"role":"user"}'),
]
SESSION = [("s1", "/k/dir")]
PART = [
    ("m1", "s1", MS(0), '{"type":"text","text":"fuuuck"}'),
    ("m2", "s1", MS(2), '{"type":"tool","tool":"grep","state":{"status":"failed"}}'),
    ("m2", "s1", MS(3), '{"type":"tool","state":{"status":"done"}}'),
    ("m4", "s2", MS(3), '{"type":"text","text":"damn"}'),
]


def _lines(path: str, rows) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        for row in rows:
            out.write((row if isinstance(row, str) else json.dumps(row)) + "\n")


def write_home(spark, home: str, opencode: bool = True) -> str:
    """All logs under ``home``; returns the path of the price catalogue."""
    _lines(f"{home}/.pi/agent/sessions/--home-u-shop--/2025_p1.jsonl", PI)
    _lines(f"{home}/.claude/projects/-w-app/deep/c1.jsonl", CLAUDE)
    _lines(f"{home}/.codex/sessions/2025/03/04/rollout-a-b-c-d-e.jsonl", CODEX)
    _lines(f"{home}/.gemini/tmp/hash1/chats/session-g1.json", [json.dumps(GEMINI, indent=1)])
    if opencode:
        from sessionmill.sources import opencode as source

        for name, rows, schema in (
            ("message", MESSAGE, source.MESSAGE), ("session", SESSION, source.SESSION), ("part", PART, source.PART)
        ):
            spark.createDataFrame(rows, schema).write.parquet(f"{home}/opencode/{name}")
    _lines(f"{home}/prices.json", [json.dumps(CATALOGUE, indent=1)])
    return f"{home}/prices.json"
