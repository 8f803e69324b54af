"""Questions on term hits, and the daily timeline that combines all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions import display as D
from sessionmill.functions import values as V
from sessionmill.plans.filters import Filters, matching
from sessionmill.plans.store import Rollups
from sessionmill.schemas import SESSION_KEY, USAGE_KEY

TOP = 20

c = F.col


def _total(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _severity_counts() -> list[Column]:
    return [
        F.sum(F.when(c("severity") == s, c("count")).otherwise(0)).alias(f"{s}_count")
        for s in ("strong", "moderate", "mild")
    ]


def _feel() -> Column:
    return F.sum(F.expr(D.feel_points("severity")) * c("count")).alias("feel_score")


def _counted(rows: DataFrame) -> DataFrame:
    """Hits as counts per session, model, group and severity.

    All questions are about counts.  Counting comes before any join, so a
    session with very many hits reaches the join as a few rows.
    """
    return rows.groupBy(*USAGE_KEY, "group_name", "severity").agg(F.count(F.lit(1)).alias("count"))


def _hit_counts(r: Rollups, f: Filters) -> DataFrame:
    """Counted hits of existing sessions that pass the filters; a tool filter asks for the tool in the session."""
    rows = _counted(f.equal(r.hits, "filename", "harness", "provider", "model"))
    rows = matching(rows, f.equal(f.recent(r.session_facts), "project"))
    return f.having(rows, lambda: r.model_tools, "tool")


def _with_tool_of_turn(counts: DataFrame, r: Rollups, f: Filters) -> DataFrame:
    """Counted hits whose turn's model used the tool; an unattributed hit accepts any model."""
    if not f.tool:
        return counts
    used = f.equal(r.model_tools, "tool").select(
        *SESSION_KEY, c("model").alias("_model"), c("provider").alias("_provider")
    ).distinct()
    h, t = counts.alias("h"), used.alias("t")
    same_session = (c("h.harness") == c("t.harness")) & (c("h.filename") == c("t.filename"))
    same_model = c("h.model").isNull() | (c("h.model") == c("t._model"))
    same_provider = c("h.provider").isNull() | c("h.provider").eqNullSafe(c("t._provider"))
    return h.join(t, same_session & same_model & same_provider, "left_semi")


def session_terms(r: Rollups, harness: str, filename: str) -> DataFrame:
    """Term groups of one session.  The feel weighs every hit of a group with the group's severity."""
    rows = r.hits.where((c("harness") == harness) & (c("filename") == filename))
    words = rows.groupBy("group_name", "severity", "word").agg(F.count(F.lit(1)).alias("count"))
    groups = words.groupBy("group_name").agg(
        F.min("severity").alias("severity"), _total("count").alias("_count"), *_severity_counts(),
        F.expr("array_join(array_sort(collect_set(word)), ', ')").alias("words"),
    ).withColumnRenamed("_count", "count")
    # Totals over the groups, no more rows than the dictionary has, before the list is cut.
    everything = Window.partitionBy(F.lit(0))
    scored = groups.withColumns({
        "total_hits": F.sum("count").over(everything),
        "feel_score": F.sum(F.expr(D.feel_points("severity")) * c("count")).over(everything),
    })
    return scored.withColumn("feel_display", F.expr(D.mood("feel_score"))).orderBy(
        F.desc("count"), "group_name"
    ).limit(TOP)


def term_groups(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = _hit_counts(r, f).groupBy("group_name").agg(
        F.min("severity").alias("severity"), _total("count").alias("count")
    )
    return groups.orderBy(F.desc("count"), "group_name").limit(TOP)


def _per_session(counts: DataFrame, *keys: str) -> DataFrame:
    """One row per session and key: what is left to count are distinct sessions."""
    return counts.groupBy(*SESSION_KEY, *keys).agg(_total("count").alias("count"))


def term_models(r: Rollups, f: Filters = Filters()) -> DataFrame:
    counts = _hit_counts(r, f).where(c("model") != "")
    groups = _per_session(counts, "model", "provider").groupBy("model", "provider").agg(
        _total("count").alias("count"), F.count(F.lit(1)).alias("sessions")
    )
    return (
        groups.withColumn("provider", F.coalesce("provider", F.lit("unknown")))
        .orderBy(F.desc("count"), "model", "provider")
        .limit(TOP)
    )


def term_harnesses(r: Rollups, f: Filters = Filters()) -> DataFrame:
    groups = _per_session(_hit_counts(r, f)).groupBy("harness").agg(
        _total("count").alias("count"), F.count(F.lit(1)).alias("sessions")
    )
    return groups.orderBy(F.desc("count"), "harness")


def term_model_harnesses(r: Rollups, f: Filters = Filters()) -> DataFrame:
    """Hits per harness, model and provider, set against the user turns of their sessions.

    Hits are first reduced to one row per session and model; joined to the
    sessions after that, every session adds its user turns once.
    """
    counts = _counted(f.equal(r.hits, "filename", "harness", "provider", "model"))
    named = _with_tool_of_turn(counts, r, f).withColumns(
        {n: F.coalesce(n, F.lit("unknown")) for n in ("model", "provider")}
    )
    per_session = named.groupBy(*USAGE_KEY).agg(
        *_severity_counts(), _feel(), _total("count").alias("_count")
    ).withColumnRenamed("_count", "count")
    sessions = f.equal(f.recent(r.session_facts), "project").select(*SESSION_KEY, "user_turns")
    sums = ("count", "strong_count", "moderate_count", "mild_count", "feel_score")
    groups = per_session.join(sessions, SESSION_KEY).groupBy("harness", "model", "provider").agg(
        *[_total(n).alias(n) for n in sums],
        F.count(F.lit(1)).alias("sessions"),
        _total("user_turns").alias("user_turns"),
    )
    return groups.select(
        "harness", "model", "provider", *sums, F.expr(D.mood("feel_score")).alias("feel_display"), "sessions",
        "user_turns", F.expr(D.ratio("count", "user_turns", 2, "0.00")).alias("swears_per_user_turn_display"),
    ).orderBy(F.desc("count"), F.desc("feel_score"), "harness", "model", "provider")


def term_summary(r: Rollups, f: Filters = Filters()) -> DataFrame:
    """One row: hits, affected sessions, rates and the most frequent group."""
    sessions = f.equal(f.recent(r.session_facts), "project", "filename", "harness")
    sessions = f.having(sessions, lambda: r.stats, "provider", "model")
    sessions = f.having(sessions, lambda: r.model_tools, "tool").select(*SESSION_KEY, "user_turns")
    counts = _counted(f.equal(r.hits, "provider", "model", "filename", "harness"))

    per_session = matching(counts, sessions).groupBy(*SESSION_KEY, "group_name").agg(
        _total("count").alias("count"),
        F.sum(F.when(c("severity") == "strong", c("count")).otherwise(0)).alias("strong"),
    )
    groups = per_session.groupBy("group_name").agg(_total("count").alias("count"), _total("strong").alias("strong"))
    parts = [
        groups.agg(
            _total("count").alias("total_swears"),
            _total("strong").alias("strong_swears"),
            F.expr("min_by(group_name, struct(-count, group_name))").alias("top_group"),
        ),
        per_session.select(*SESSION_KEY).distinct().agg(F.count(F.lit(1)).alias("sessions_with_swears")),
        sessions.agg(F.count(F.lit(1)).alias("sessions"), _total("user_turns").alias("user_turns")),
    ]
    # Three single rows with different columns become one.
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(
        *[_total(n).alias(n)
          for n in ("total_swears", "strong_swears", "sessions_with_swears", "sessions", "user_turns")],
        F.coalesce(F.max("top_group"), F.lit("")).alias("top_group"),
    )
    return row.select(
        "*",
        F.expr(D.ratio("total_swears", "user_turns", 2, "0.00")).alias("swears_per_user_turn_display"),
        F.expr(D.ratio("total_swears", "sessions", 2, "0.00")).alias("swears_per_session_display"),
        F.expr(D.percent("sessions_with_swears", "sessions")).alias("sessions_with_swears_pct"),
    )


def timeline(r: Rollups, f: Filters = Filters(), zone: str = "UTC") -> DataFrame:
    """Daily spend, tokens, tools and term hits, by the day a session started.

    The three kinds of rows are reduced to one row per session before they meet
    the session table; a day appears if any of them has a row on it.
    """
    usage = f.equal(r.stats, "filename", "harness", "provider", "model")
    if f.tool:
        used = f.equal(r.model_tools, "tool").select(
            *SESSION_KEY, c("model").alias("_model"), c("provider").alias("_provider")
        ).distinct()
        s, t = usage.alias("s"), used.alias("t")
        usage = s.join(
            t,
            (c("s.harness") == c("t.harness")) & (c("s.filename") == c("t.filename"))
            & (c("s.model") == c("t._model")) & c("s.provider").eqNullSafe(c("t._provider")),
            "left_semi",
        )
    calls = f.equal(r.model_tools, "filename", "harness", "provider", "model", "tool")
    hits = _with_tool_of_turn(_counted(f.equal(r.hits, "filename", "harness", "provider", "model")), r, f)

    measures = (
        usage.select(*SESSION_KEY, "cost", (c("in_tok") + c("out_tok") + c("cache_tok")).alias("tokens"))
        .unionByName(
            calls.select(*SESSION_KEY, c("count").alias("tool_calls"), c("errors").alias("tool_errors")),
            allowMissingColumns=True,
        )
        .unionByName(
            hits.select(
                *SESSION_KEY, c("count").alias("profanity_hits"),
                (F.expr(D.feel_points("severity")) * c("count")).alias("feel_score"),
            ),
            allowMissingColumns=True,
        )
    )
    counts = ("tokens", "tool_calls", "tool_errors", "profanity_hits", "feel_score")
    per_session = measures.groupBy(*SESSION_KEY).agg(
        F.sum("cost").alias("cost"), *[F.sum(n).alias(n) for n in counts]
    )
    started = f.equal(f.recent(r.session_facts), "project", "filename", "harness").where(c("start_time") > 0)
    day = V.zone_date(c("start_time"), zone).cast("string").alias("date")
    daily = per_session.join(started.select(*SESSION_KEY, day), SESSION_KEY).groupBy("date").agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), *[_total(n).alias(n) for n in counts]
    )
    return daily.select(
        "date", "cost", F.expr(D.money("cost", 2)).alias("cost_display"),
        "tokens", F.expr(D.human_count("tokens")).alias("tokens_display"),
        "tool_calls", F.expr(D.human_count("tool_calls", "M")).alias("tool_calls_display"),
        "tool_errors", F.expr(D.human_count("tool_errors", "M")).alias("tool_errors_display"),
        "profanity_hits", F.expr(D.human_count("profanity_hits", "M")).alias("profanity_hits_display"),
        "feel_score", F.expr(D.mood("feel_score")).alias("feel_display"),
    ).orderBy("date")
