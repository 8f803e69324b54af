"""Events rolled up to session x model x tool, session x model, and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions import display as D
from sessionmill.operators.attribution import attribute_tools
from sessionmill.schemas import SESSION_KEY, USAGE_KEY


def model_tools(events: DataFrame) -> DataFrame:
    """Tool calls and tool errors per session, model, provider and tool."""
    calls = attribute_tools(events).groupBy(*USAGE_KEY, "tool")
    return calls.agg(F.sum("calls").alias("count"), F.sum("errors").alias("errors"))


def session_model_stats(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Turns, usage and attributed tools per session, model and provider.

    One grouping over a model's own events and its ``model_tools`` rows.  A tool
    is only ever attributed to a model with a turn, so the second kind of row
    adds no keys; grouping treats a NULL provider as a value.
    """
    used = "coalesce(cost <> 0 OR in_tok + out_tok + cache_tok > 0, false)"
    turned = "coalesce(is_turn = 1, false)"
    own = events.where(f"model <> '' AND ({used} OR {turned})").selectExpr(
        *USAGE_KEY,
        f"if({used} AND raw_model <> '', raw_model, NULL) AS used_raw",
        f"if({turned} AND raw_model <> '', raw_model, NULL) AS turned_raw",
        f"bigint({turned}) AS turns",
        *[f"if({used}, {n}, NULL) AS {n}" for n in ("cost", "in_tok", "out_tok", "cache_tok")],
    )
    attributed = tools.select(*USAGE_KEY, F.col("count").alias("tools"), "errors")
    merged = own.unionByName(attributed, allowMissingColumns=True).groupBy(*USAGE_KEY)
    sums = ("turns", "cost", "in_tok", "out_tok", "cache_tok", "tools", "errors")
    return merged.agg(
        F.expr("coalesce(min(used_raw), min(turned_raw))").alias("raw_model"),
        *[F.expr(f"coalesce(sum({n}), {'0D' if n == 'cost' else '0L'})").alias(n) for n in sums],
    ).select(*SESSION_KEY, "raw_model", "model", "provider", *sums)


def session_facts(events: DataFrame) -> DataFrame:
    """One row per session that has a valid time: all that its own events tell.

    A reader that needs only a few columns lets the optimiser drop the join it
    does not use.
    """
    base = events.groupBy(*SESSION_KEY).agg(
        F.expr("min(if(ts > 0, ts, NULL))").alias("start_time"),
        F.expr("max(if(ts > 0, ts, NULL))").alias("end_time"),
        F.min("project").alias("project"),
        F.max("session_cwd").alias("cwd"),
        F.expr("array_sort(collect_set(model))").alias("_models"),
        *[F.sum(n).alias(n) for n in ("cost", "in_tok", "out_tok", "cache_tok")],
        F.expr("count_if(is_user = 1)").alias("user_turns"),
        F.expr("count_if(is_turn = 1)").alias("agent_turns"),
        F.expr("count_if(is_error = 1)").alias("errors"),
    ).where("start_time IS NOT NULL")
    return base.join(_tool_maps(events), SESSION_KEY, "left").selectExpr(
        *SESSION_KEY,
        "start_time",
        "end_time",
        "(end_time - start_time) / 1000 AS duration_sec",
        "project",
        "cwd",
        "if(size(_models) > 0, _models, NULL) AS models",
        "cost",
        "in_tok",
        "out_tok",
        "cache_tok",
        "user_turns",
        "agent_turns",
        "errors",
        "coalesce(tool_count, 0L) AS tool_count",
        "coalesce(tool_error_count, 0L) AS tool_error_count",
        "coalesce(tool_breakdown, CAST(map() AS MAP<STRING, BIGINT>)) AS tool_breakdown",
        "coalesce(tool_error_breakdown, CAST(map() AS MAP<STRING, BIGINT>)) AS tool_error_breakdown",
    )


def sessions(events: DataFrame, tools: DataFrame, stats: DataFrame) -> DataFrame:
    """``session_facts`` with the lists of a session's models and their tools.

    All inputs of the joins are grouped by the session key, so they are already
    co-partitioned.
    """
    facts = session_facts(events)
    lists = {"model_tool_breakdown": _model_tool_lists(tools), "model_stats": _model_stat_lists(stats)}
    for listed in lists.values():
        facts = facts.join(listed, SESSION_KEY, "left")
    return facts.withColumns({name: F.coalesce(name, F.array()) for name in lists})


def _tool_maps(events: DataFrame) -> DataFrame:
    """Every row with a tool name counts here, whether or not it is flagged as a tool call."""
    per_tool = (
        events.where("tool IS NOT NULL")
        .groupBy(*SESSION_KEY, "tool")
        .agg(F.expr("count(1)").alias("n"), F.expr("count_if(is_error = 1)").alias("bad"))
    )

    def as_map(value: str) -> Column:
        return F.expr(f"map_from_entries(array_sort(collect_list(struct(tool, {value}))))")

    return per_tool.groupBy(*SESSION_KEY).agg(
        F.sum("n").alias("tool_count"),
        F.sum("bad").alias("tool_error_count"),
        as_map("n").alias("tool_breakdown"),
        as_map("bad").alias("tool_error_breakdown"),
    )


def _model_tool_lists(tools: DataFrame) -> DataFrame:
    item = F.expr(
        f"struct(model, tool, count, errors, {D.percent('errors', 'count')} AS error_pct)"
    )
    return tools.groupBy(*SESSION_KEY).agg(F.array_sort(F.collect_list(item)).alias("model_tool_breakdown"))


def _model_stat_lists(stats: DataFrame) -> DataFrame:
    item = F.expr(f"""struct(
        model, provider, turns, cost, in_tok, out_tok, cache_tok, tools, errors,
        {D.money('cost')} AS cost_display,
        {D.token_breakdown('in_tok', 'out_tok', 'cache_tok')} AS token_breakdown_display,
        {D.percent('errors', 'tools')} AS error_pct,
        {D.money_ratio('cost', 'turns')} AS cost_per_turn_display,
        {D.money_ratio('cost', 'tools')} AS cost_per_tool_display
    )""")
    return stats.groupBy(*SESSION_KEY).agg(F.array_sort(F.collect_list(item)).alias("model_stats"))
