"""Questions on spend, tokens, turns and tools.

Each function takes the rollups and a filter set and returns a lazy frame.
Which filter acts on rows and which on whole sessions differs per question; the
README has the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import display as D
from sessionmill.functions import values as V
from sessionmill.operators import resume
from sessionmill.plans.filters import Filters
from sessionmill.plans.store import Rollups
from sessionmill.schemas import USAGE_KEY

SESSION_ROWS = 100
SHOWN_SESSIONS = 25

c = F.col

def _tokens() -> Column:
    return c("in_tok") + c("out_tok") + c("cache_tok")


def _total(value: Column | str, kind: str = "bigint") -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(kind)


def _spend() -> Column:
    return _total("cost", "double").alias("spend")


# Durations that count towards a mean: above zero and below a day.
_SANE = "if(duration_sec > 0 AND duration_sec < 86400, duration_sec, NULL)"


def _mean_duration() -> Column:
    return F.expr(D.round_even(f"coalesce(avg({_SANE}), 0D)")).alias("avg_duration")


def _sessions_by_content(r: Rollups, f: Filters) -> DataFrame:
    """Sessions with the row filters, and with a model or tool as asked for."""
    return _session_rows(r.session_facts, r, f)


def summary(r: Rollups, f: Filters = Filters()) -> DataFrame:
    """One row of key figures.  Total tokens leave out cache reads; sessions count distinct file names."""
    totals = _sessions_by_content(r, f).agg(
        _total("cost", "double").alias("total_spend"),
        _total(c("in_tok") + c("out_tok")).alias("total_tokens"),
        _total("in_tok").alias("in_tokens"),
        _total("out_tok").alias("out_tokens"),
        _total("cache_tok").alias("cache_tokens"),
        F.count_distinct("filename").alias("sessions"),
        _mean_duration(),
        F.expr(f"count({_SANE})").alias("timed_sessions"),
        _total("tool_count").alias("tool_calls"),
        _total("tool_error_count").alias("tool_errors"),
        _total("agent_turns").alias("agent_turns"),
        _total("user_turns").alias("user_turns"),
        F.count(F.when(F.size("models") > 1, 1)).alias("multi_model_sessions"),
    )
    per_turn = f"if(total_turns = 0, 0L, {D.round_even('total_tokens / nullif(total_turns, 0)')})"
    derived = totals.withColumn("total_turns", c("agent_turns") + c("user_turns"))
    derived = derived.withColumn("_per_turn", F.expr(per_turn))
    return derived.select(
        *totals.columns,
        F.expr(D.money("total_spend", 2)).alias("total_spend_display"),
        F.expr(D.human_count("total_tokens")).alias("total_tokens_display"),
        F.expr(D.token_breakdown("in_tokens", "out_tokens", "cache_tokens")).alias("token_breakdown_display"),
        F.expr(D.percent("multi_model_sessions", "sessions")).alias("multi_model_sessions_pct"),
        F.expr(D.human_duration("avg_duration")).alias("avg_duration_display"),
        F.expr(D.human_count("tool_calls")).alias("tool_calls_display"),
        F.expr(D.human_count("tool_errors")).alias("tool_errors_display"),
        F.expr(D.percent("tool_errors", "tool_calls")).alias("tool_error_pct"),
        F.expr(D.money_ratio("total_spend", "sessions", 2)).alias("avg_cost_per_session_display"),
        "total_turns",
        F.expr(D.human_count("_per_turn")).alias("avg_tokens_per_turn_display"),
        F.expr(D.ratio("tool_calls", "sessions", 1, "0")).alias("avg_tools_per_session_display"),
    )


def _usage(r: Rollups, f: Filters) -> DataFrame:
    rows = f.equal(r.stats, "filename", "harness", "provider", "model")
    return f.in_sessions(rows, r.session_facts)


def harnesses(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = f.having(_usage(r, f), lambda: r.session_tools, "tool").groupBy("harness").agg(
        _spend(), _total(_tokens()).alias("tokens"), *[_total(n).alias(n) for n in ("turns", "tools", "errors")]
    )
    return groups.select(
        "harness", "spend", F.expr(D.money("spend")).alias("spend_display"),
        "tokens", F.expr(D.human_count("tokens")).alias("tokens_display"), "turns", "tools", "errors",
    ).orderBy(*f.sort("harnesses"))


def providers(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = f.having(_usage(r, f), lambda: r.session_tools, "tool").groupBy("provider").agg(
        _spend(), _total(_tokens()).alias("tokens"), *[_total(n).alias(n) for n in ("tools", "errors")]
    )
    return groups.select(
        "provider", "spend", F.expr(D.money("spend")).alias("spend_display"),
        "tokens", F.expr(D.human_count("tokens")).alias("tokens_display"), "tools", "errors",
    ).orderBy(*f.sort("providers"))


def models(r: Rollups, f: Filters = Filters()) -> DataFrame:
    """Per model and provider, with the usage that has tokens but no price.

    A usage row is one session of a model, so counting rows counts sessions.
    The tool filter compares providers with plain equality: a model without a
    provider never matches it.
    """
    rows = _usage(r, f).where(c("model") != "")
    if f.tool:
        used = f.equal(r.model_tools, "tool").select(*USAGE_KEY).distinct()
        rows = rows.join(used, USAGE_KEY, "left_semi")
    session = F.concat("harness", F.lit(":"), "filename")
    unpriced = (c("cost") == 0) & (_tokens() > 0)
    groups = rows.groupBy("model", "provider").agg(
        _spend(),
        F.count(session).alias("sessions"),
        _total(_tokens()).alias("tokens"),
        _total(F.when(unpriced, _tokens()).otherwise(0)).alias("unpriced_tokens"),
        F.count(F.when(unpriced, session)).alias("unpriced_sessions"),
        _total("tools").alias("tools"),
        _total("errors").alias("errors"),
    )
    mean = F.when(c("sessions") == 0, 0.0).otherwise(c("spend") / F.nullif(c("sessions"), F.lit(0)))
    return groups.withColumn("avg_cost_per_session", mean).select(
        "model", F.coalesce("provider", F.lit("unknown")).alias("provider"),
        "spend", F.expr(D.money("spend")).alias("spend_display"), "sessions",
        "avg_cost_per_session", F.expr(D.money("avg_cost_per_session")).alias("avg_cost_per_session_display"),
        "tokens", F.expr(D.human_count("tokens")).alias("tokens_display"),
        "unpriced_tokens", F.expr(D.human_count("unpriced_tokens")).alias("unpriced_tokens_display"), "unpriced_sessions",
        "tools", "errors",
    ).orderBy(*f.sort("models"))


def projects(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = _sessions_by_content(r, f).groupBy("project").agg(
        _spend(), F.count(F.lit(1)).alias("sessions"), _mean_duration()
    )
    return groups.select(
        "project", "spend", F.expr(D.money("spend")).alias("spend_display"), "sessions",
        "avg_duration", F.expr(D.human_duration("avg_duration")).alias("avg_duration_display"),
    ).orderBy(*f.sort("projects"))


def _tool_groups(r: Rollups, f: Filters, *keys: str) -> DataFrame:
    rows = f.equal(r.model_tools, "filename", "harness", "provider", "model", "tool")
    rows = f.in_sessions(rows.where(c("tool").isNotNull()), r.session_facts)
    groups = rows.groupBy(*keys).agg(_total("count").alias("count"), _total("errors").alias("errors"))
    return groups.withColumn("error_pct", F.expr(D.percent("errors", "count")))


def tools(r: Rollups, f: Filters = Filters()) -> DataFrame:
    return _tool_groups(r, f, "tool").orderBy(*f.sort("tools"))


def model_tools(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = _tool_groups(r, f, "model", "provider", "tool").where(c("model").isNotNull())
    return groups.withColumn("provider", F.coalesce("provider", F.lit("unknown"))).select(
        "model", "provider", "tool", "count", "errors", "error_pct"
    ).orderBy(*f.sort("model_tools"))


def _session_rows(sessions: DataFrame, r: Rollups, f: Filters) -> DataFrame:
    rows = f.equal(f.recent(sessions), "project", "filename", "harness")
    return f.with_tool(f.having(rows, lambda: r.stats, "provider", "model"))


def session_count(r: Rollups, f: Filters = Filters()) -> DataFrame:
    """How many sessions the list is the top of."""
    return _session_rows(r.session_facts, r, f).agg(F.count(F.lit(1)).alias("sessions"))


def session_list(r: Rollups, f: Filters = Filters(), rows: int = SESSION_ROWS, zone: str = "UTC") -> DataFrame:
    """The first sessions in the chosen order, latest first by default."""
    return listed_sessions(r, f, rows, zone).drop("_key")


def listed_sessions(
    r: Rollups, f: Filters, rows: int, zone: str = "UTC", part: Callable[[DataFrame], DataFrame] = lambda facts: facts
) -> DataFrame:
    """The first sessions of a ``part`` of all, with the values they are sorted by as ``_key``."""
    order = f.sort("sessions")
    # The order is decided on few columns; lists and texts are made for the rows kept.
    facts = _session_rows(r.session_facts, r, f).withColumn("total_tokens", _tokens())
    first = part(facts).orderBy(*order).limit(rows)
    seconds = F.floor(c("end_time") / 1000) - F.floor(c("start_time") / 1000)
    kept = r.sessions_of(first).withColumns({"total_tokens": _tokens(), "duration_sec_calc": seconds})
    key = F.struct(*[name for name, _ in f.keys("sessions")]).alias("_key")
    return kept.orderBy(*order).limit(rows).select(
        "harness", "filename",
        V.zone_text(c("start_time"), zone).alias("start_time_str"),
        V.zone_text(c("end_time"), zone).alias("end_time_str"),
        "duration_sec_calc", "project", "cwd", "cost", "in_tok", "out_tok", "cache_tok", "total_tokens",
        "user_turns", "agent_turns", (c("user_turns") + c("agent_turns")).alias("total_turns"),
        "errors", "tool_count", "tool_error_count",
        F.to_json("tool_breakdown").alias("tool_breakdown_json"),
        F.to_json("tool_error_breakdown").alias("tool_error_breakdown_json"),
        F.to_json("model_tool_breakdown").alias("model_tool_breakdown_json"),
        F.to_json("model_stats", {"ignoreNullFields": "false"}).alias("model_stats_json"),
        F.coalesce(F.to_json("models"), F.lit("[]")).alias("models_json"),
        F.expr(D.money("cost")).alias("cost_display"),
        F.expr(D.human_count("total_tokens")).alias("total_tokens_display"),
        F.expr(D.token_breakdown("in_tok", "out_tok", "cache_tok")).alias("token_breakdown_display"),
        F.expr(D.human_duration("duration_sec_calc")).alias("duration_display"),
        F.expr(D.percent("tool_error_count", "tool_count")).alias("tool_error_pct"),
        resume.resume_command(c("harness"), c("filename"), c("cwd")).alias("resume_command"),
        resume.resume_label(c("harness")).alias("resume_label"),
        key,
    )
