"""Queries over the test tables, one or more per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmill.functions import display as D
from sessionmill.functions import values as V
from sessionmill.operators import attribution, detect, lexicon, resume, rollups
from sessionmill.operators import pricing as P
from sessionmill.operators.asof import asof
from sessionmill.plans import overview, terms
from sessionmill.plans.filters import Filters
from sessionmill.plans.store import Rollups
from sessionmill.sources import claude, codex, gemini, opencode, pi, registry
from workload import adapter, logs

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2024, 1, 31)

# One filter each; a query per filter stacks the answers of all questions.
FILTERS = {
    "none": Filters(as_of=AS_OF),
    "days": Filters(days=17, as_of=AS_OF),
    "project": Filters(project="p3"),
    "filename": Filters(filename="s13-1"),
    "harness": Filters(harness="pi"),
    "provider": Filters(provider="v1"),
    "model": Filters(model="m1"),
    "tool": Filters(tool="t4"),
    "several": Filters(days=25, harness="pi", provider="v1", tool="t4", as_of=AS_OF),
}


def rounded(frame: DataFrame, **places: int) -> DataFrame:
    """Sums of doubles depend on the order of addition; compare them rounded."""
    return frame.withColumns({name: F.round(name, n) for name, n in places.items()})


def _events(question, **places: int) -> Query:
    return lambda spark, sf: rounded(question(adapter.event_rollups(spark, sf)), **places)


def _all(question, **places: int) -> Query:
    return lambda spark, sf: rounded(question(adapter.all_rollups(spark, sf)), **places)


def stacked(r: Rollups, f: Filters) -> DataFrame:
    """Answers of all questions under one filter, as (question, key, amount, number)."""

    def rows(question: str, frame: DataFrame, key: str, amount: str, number: str) -> DataFrame:
        return frame.selectExpr(
            f"'{question}' AS question", f"{key} AS key", f"round(double({amount}), 4) AS amount",
            f"bigint({number}) AS number",
        )

    pair = "concat(model, '/', provider)"
    parts = [
        rows("summary", overview.summary(r, f), "'all'", "total_spend", "sessions * 1000003 + tool_calls"),
        rows("harnesses", overview.harnesses(r, f), "harness", "spend", "tokens + turns * 7 + tools * 3 + errors"),
        rows("providers", overview.providers(r, f), "coalesce(provider, '-')", "spend", "tokens + tools * 3 + errors"),
        rows("models", overview.models(r, f), pair, "spend", "tokens + sessions * 7 + tools * 3 + errors"),
        rows("projects", overview.projects(r, f), "project", "spend", "sessions * 1000003 + avg_duration"),
        rows("tools", overview.tools(r, f), "tool", "errors", "count"),
        rows("model_tools", overview.model_tools(r, f), f"concat({pair}, '/', tool)", "errors", "count"),
        rows("sessions", overview.session_count(r, f), "'all'", "0", "sessions"),
        rows("timeline", terms.timeline(r, f), "date", "cost",
             "tokens + tool_calls * 3 + tool_errors * 5 + profanity_hits * 7 + feel_score * 11"),
        rows("groups", terms.term_groups(r, f), "group_name", "0", "count"),
        rows("term_models", terms.term_models(r, f), pair, "sessions", "count"),
        rows("term_harnesses", terms.term_harnesses(r, f), "harness", "sessions", "count"),
        rows("term_pairs", terms.term_model_harnesses(r, f), f"concat(harness, '/', {pair})", "feel_score",
             "count + sessions * 1000 + user_turns * 1000000"),
        rows("term_summary", terms.term_summary(r, f), "top_group", "sessions_with_swears",
             "total_swears + strong_swears * 1000 + sessions * 1000000 + user_turns * 1000000000"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _filtered(name: str) -> Query:
    return lambda spark, sf: stacked(adapter.all_rollups(spark, sf), FILTERS[name])


def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adapter.event_rollups(spark, sf).stats, cost=4)


PAIR_TEXT = "x.model, x.tool, x.count, x.errors, x.error_pct"
STAT_TEXT = (
    "x.model, coalesce(x.provider, '-'), x.turns, x.in_tok, x.out_tok, x.cache_tok, x.tools, x.errors, x.cost_display, "
    "x.token_breakdown_display, x.error_pct, x.cost_per_turn_display, x.cost_per_tool_display"
)


def _nested(column: str, fields: str) -> str:
    return f"array_join(array_sort(transform({column}, x -> concat_ws('|', {fields}))), ';')"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The session table with its nested columns as text."""
    table = adapter.event_rollups(spark, sf).sessions
    return rounded(table, cost=4).selectExpr(
        "harness", "filename", "start_time", "end_time", "duration_sec", "project", "cwd",
        "array_join(models, ',') AS models", "cost", "in_tok", "out_tok", "cache_tok", "user_turns", "agent_turns",
        "errors", "tool_count", "tool_error_count",
        "to_json(tool_breakdown) AS tool_breakdown", "to_json(tool_error_breakdown) AS tool_error_breakdown",
        f"{_nested('model_tool_breakdown', PAIR_TEXT)} AS model_tool_breakdown",
        f"{_nested('model_stats', STAT_TEXT)} AS model_stats",
    )


def session_list(spark: SparkSession, sf: str) -> DataFrame:
    """Top sessions by tokens; the nested columns' JSON is read back and compared as text."""
    f = Filters(sort_table="sessions", sort_by="tokens", sort_dir="desc")
    listed = overview.session_list(adapter.event_rollups(spark, sf), f)
    pairs = F.from_json("model_tool_breakdown_json", "array<struct<model string, tool string, count bigint, errors bigint, error_pct string>>")
    stats = F.from_json("model_stats_json", (
        "array<struct<model string, provider string, turns bigint, cost double, in_tok bigint, out_tok bigint, cache_tok bigint, "
        "tools bigint, errors bigint, cost_display string, token_breakdown_display string, error_pct string, "
        "cost_per_turn_display string, cost_per_tool_display string>>"
    ))
    read_back = listed.withColumns({"model_tool_breakdown_json": pairs, "model_stats_json": stats})
    return rounded(read_back, cost=4).withColumns({
        "model_tool_breakdown_json": F.expr(_nested("model_tool_breakdown_json", PAIR_TEXT)),
        "model_stats_json": F.expr(_nested("model_stats_json", STAT_TEXT)),
    })


def hit_ids(spark: SparkSession, sf: str) -> DataFrame:
    """As many ids as hits."""
    return adapter.chat_hits(spark, sf).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("hit_id").alias("ids"))


def hit_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every user message of the chats set to the turn that answers it."""
    asked = adapter.chat_messages(spark, sf).drop("text")
    turns = attribution.turns(adapter.chat_turns(spark, sf))
    found = asof(asked, turns, ["harness", "filename"], "ts", "turn", forward=True)
    return found.select("filename", "ts", "turn.model", "turn.provider")


def tool_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every call with its turn; counted calls are told apart again, the failed ones first."""
    counted = attribution.attribute_tools(adapter.event_rows(spark, sf), how="left")
    return counted.selectExpr(
        "harness", "filename", "ts", "tool", "model", "provider", "errors", "explode(sequence(1L, calls)) AS nth"
    ).selectExpr("harness", "filename", "ts", "tool", "int(nth <= errors) AS is_error", "model", "provider")


def tool_errors(spark: SparkSession, sf: str) -> DataFrame:
    parsed = claude.parse(logs.claude(spark, sf))
    judged = claude.judge_tool_uses(claude.tool_uses(parsed), claude.tool_results(parsed))
    return judged.selectExpr("filename", "timestamp", "model", "uuid", "use_id", "tool", "is_error")


def session_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.session_terms(adapter.all_rollups(spark, sf), "pi", "c0")


def document_terms(mode: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        documents = adapter.table(spark, sf, "documents").select("doc_id", "text")
        return detect.detect(documents, adapter.LEXICON, mode=mode)

    return query


def document_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of 100 000 entries, terms of several words among them."""
    documents = adapter.table(spark, sf, "documents").select("doc_id", "text")
    return detect.detect(documents, adapter.large_lexicon(spark))


def document_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = document_terms("compat")(spark, sf)
    return found.groupBy("word", "group_name", "severity").agg(
        F.expr("count(1)").alias("hits"), F.expr("count_if(pass = 2)").alias("collapsed_hits")
    )


def built_in_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in dictionary over all documents and chats."""
    texts = adapter.table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "text").unionByName(
        adapter.table(spark, sf, "conversations").selectExpr("concat('c', conv_id, '-', turn) AS id", "text")
    )
    found = detect.detect(texts, lexicon.built_in_rows())
    return found.groupBy("word", "group_name", "severity").agg(F.expr("count(1)").alias("hits"))


def lexicon_merge(mode: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        part = adapter.table(spark, sf, "part")
        default = part.selectExpr(
            "concat(' ', upper(p_name), ' ') AS word", "element_at(array('mild', '', 'strong'), p_size % 3 + 1) AS severity",
            "if(p_size % 4 = 0, ' ', p_brand) AS group", "p_partkey AS position",
        )
        custom = part.selectExpr(
            "if(p_size > 40, p_type, p_name) AS word", "'moderate' AS severity", "lower(p_type) AS group",
            "p_partkey AS position",
        )
        return lexicon.merge(default, custom, mode)

    return query


def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Every event priced by the catalogue, with and without a cache-write price; some have no model, some no price."""
    rows = adapter.log_rows(spark, sf)
    priced = P.with_prices(rows, logs.prices(spark, sf).overlaid, F.col("model"))
    k = F.col("k")
    return priced.select(
        "event_id",
        F.round(P.usage_cost(k * 100, k * 10, k * 50), 9).alias("plain"),
        F.round(P.usage_cost(k * 100, k * 10, k * 50, k * 5), 9).alias("with_writes"),
        F.round(P.recorded_or(F.when(k % 10 == 0, 0.0).otherwise(F.col("value")), P.usage_cost(k * 100, k * 10, k * 50)), 9)
        .alias("recorded_first"),
    )


def catalogue_prices(spark: SparkSession, sf: str) -> DataFrame:
    return P.price_per_model(P.flatten_catalogue(logs.catalogue(spark, sf)))


def overlaid_prices(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame(list(logs.ALIASES), "raw_model string, api_model string")
    return P.overlay_aliases(catalogue_prices(spark, sf), aliases)


def _normalized(source: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = logs.prices(spark, sf)
        module = {"pi": pi, "opencode": opencode, "claude": claude, "codex": codex, "gemini": gemini}[source]
        raw = getattr(logs, source)(spark, sf)
        return rounded(module.normalize(raw, p.listed if source == "gemini" else p.overlaid), cost=9)

    return query


def _messages(source: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        module = {"pi": pi, "opencode": opencode, "claude": claude, "codex": codex, "gemini": gemini}[source]
        return module.messages(getattr(logs, source)(spark, sf))

    return query


def _raw_and_parsed(spark: SparkSession, sf: str) -> tuple[dict[str, registry.Raw], dict[str, registry.Raw]]:
    """All five sources' raw logs, and what is parsed of them, stored as in a refresh: each log is made and parsed once."""
    rows = logs.dealt_rows(spark, sf)
    raw = {s: getattr(logs, s)(spark, sf, rows) for s in registry.SOURCES}
    # opencode is read from exported tables; messages and sessions are each looked at several times.
    raw["opencode"] |= {table: adapter.stored(raw["opencode"][table]) for table in ("message", "session")}
    parsed = registry.parse_all(raw)
    return raw, {name: adapter.stored(frame) if isinstance(frame, DataFrame) else frame for name, frame in parsed.items()}


def _unified(spark: SparkSession, sf: str, parsed: dict[str, registry.Raw]) -> DataFrame:
    return rounded(registry.unified_events(parsed, logs.prices(spark, sf, adapter.stored)), cost=9)


def unified_events(spark: SparkSession, sf: str) -> DataFrame:
    """All five sources' raw logs to one event table, as a refresh makes it."""
    return _unified(spark, sf, _raw_and_parsed(spark, sf)[1])


def log_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw logs to sessions. Costs are compared by eight places, which no sum here is halfway between."""
    stats = "x.model, coalesce(x.provider, '-'), x.turns, x.in_tok, x.out_tok, x.cache_tok, x.tools, x.errors, x.error_pct"
    events = adapter.stored(unified_events(spark, sf))
    tools = adapter.stored(rollups.model_tools(events))
    table = Rollups(events, model_tools=tools, stats=adapter.stored(rollups.session_model_stats(events, tools))).sessions
    return rounded(table, cost=8).selectExpr(
        "harness", "filename", "start_time", "end_time", "duration_sec", "project", "cwd", "array_join(models, ',') AS models",
        "cost", "in_tok", "out_tok", "cache_tok", "user_turns", "agent_turns", "errors", "tool_count", "tool_error_count",
        "to_json(tool_breakdown) AS tool_breakdown", "to_json(tool_error_breakdown) AS tool_error_breakdown",
        f"{_nested('model_tool_breakdown', PAIR_TEXT)} AS model_tool_breakdown", f"{_nested('model_stats', stats)} AS model_stats",
    )


def log_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Raw logs to term hits with the turn that answers them."""
    raw, parsed = _raw_and_parsed(spark, sf)
    events = adapter.stored(_unified(spark, sf, parsed))
    hits = adapter.stored(registry.term_hits(raw, logs.TERMS, parsed=parsed, stage=lambda name: adapter.stored))
    return Rollups(events, hits).hits.drop("hit_id")


def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every display form, over the values of ``lineitem``."""
    price, quantity = "l_extendedprice", "bigint(l_quantity)"
    texts = {
        "money4": D.money(f"{price} / 7"),
        "money2": D.money(f"{price} * l_discount", 2),
        "one_place": D.fixed(f"{price} / 8", 1),
        "tie": D.fixed("l_quantity / 4", 1),
        "count_k": D.human_count(f"bigint({price}) * l_linenumber"),
        "count_b": D.human_count(f"bigint({price}) * 100000"),
        "count_m": D.human_count(f"bigint({price}) * 100000", "M"),
        "breakdown": D.token_breakdown(quantity, f"{quantity} * 100", f"{quantity} * 1000000"),
        "duration": D.human_duration(f"{quantity} * l_linenumber * 97 - 97"),
        "share": D.percent("l_linenumber", quantity),
        "share_of_zero": D.percent("l_linenumber", f"{quantity} - {quantity}"),
        "rate": D.ratio(price, quantity, 2, "0.00"),
        "whole": D.round_even("l_quantity / 2"),
        "mood": D.mood("l_linenumber * 2 - 2"),
    }
    return adapter.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", *[f"{t} AS {n}" for n, t in texts.items()])


def resume_commands(spark: SparkSession, sf: str) -> DataFrame:
    """File names in every harness's manner, made from ``events``."""
    rows = adapter.log_rows(spark, sf).selectExpr(
        "event_id", "harness",
        "CASE event_id % 4 WHEN 0 THEN concat('/l/2024_', user_id, '_id', k, '.jsonl') "
        "WHEN 1 THEN concat('/l/rollout-2024-01-', k, '-a-b-c-d-', user_id, '.jsonl') "
        "WHEN 2 THEN concat('/l/session-', k, '-', user_id, '.json') ELSE concat('ses', k) END AS filename",
        "if(k % 2 = 0, concat('/w/', project), NULL) AS cwd",
    )
    h, name, cwd = F.col("harness"), F.col("filename"), F.col("cwd")
    return rows.select(
        "event_id", "harness", "filename", resume.session_id(h, name).alias("session_id"),
        resume.resume_command(h, name, cwd).alias("command"), resume.resume_label(h).alias("label"),
    )


def sorted_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Providers in ascending and descending order, numbered as they come; the NULL provider is last in both."""
    r = adapter.event_rollups(spark, sf)
    parts = []
    for direction in ("asc", "desc"):
        f = Filters(sort_table="providers", sort_by="provider", sort_dir=direction)
        # Ids grow in the order of the frame, with gaps between its partitions.
        found = overview.providers(r, f).select("provider", F.monotonically_increasing_id().alias("_id"))
        place = F.row_number().over(Window.orderBy("_id")).cast("bigint").alias("place")
        parts.append(found.select(F.lit(direction).alias("direction"), "provider", place))
    return parts[0].unionByName(parts[1])


def daily_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Instants to dates and texts in UTC."""
    rows = adapter.log_rows(spark, sf)
    return rows.select(
        "event_id", "ms", V.utc_date(F.col("ms")).cast("string").alias("day"), V.zone_text(F.col("ms")).alias("text"),
    )


QUERIES: dict[str, Query] = {
    "summary_kpis": _events(overview.summary, total_spend=4),
    "harness_rollup": _events(overview.harnesses, spend=4),
    "provider_rollup": _events(overview.providers, spend=4),
    "model_rollup": _events(overview.models, spend=4, avg_cost_per_session=4),
    "project_rollup": _events(overview.projects, spend=4),
    "tool_rollup": _events(overview.tools),
    "model_tool_rollup": _events(overview.model_tools),
    "daily_timeline": _all(terms.timeline, cost=4),
    "session_list_top": session_list,
    "session_terms": session_terms,
    "term_groups": _all(terms.term_groups),
    "term_models": _all(terms.term_models),
    "term_harnesses": _all(terms.term_harnesses),
    "term_model_harness": _all(terms.term_model_harnesses),
    "term_summary": _all(terms.term_summary),
    "session_model_stats": session_stats,
    "model_tools": lambda spark, sf: adapter.event_rollups(spark, sf).model_tools,
    "sessions": sessions,
    "term_hits": lambda spark, sf: adapter.all_rollups(spark, sf).hits.drop("hit_id"),
    "hit_ids": hit_ids,
    "tool_turn_asof": tool_turns,
    "hit_turn_asof": hit_turns,
    "tool_error_or_join": tool_errors,
    "pricing_flatten": catalogue_prices,
    "pricing_alias_overlay": overlaid_prices,
    "usage_cost": usage_cost,
    **{f"normalize_{s}": _normalized(s) for s in ("pi", "opencode", "claude", "codex", "gemini")},
    "unified_events": unified_events,
    "pipeline_sessions": log_sessions,
    "pipeline_hits": log_hits,
    **{f"messages_{s}": _messages(s) for s in ("pi", "opencode", "claude", "codex", "gemini")},
    "detect_terms": document_terms("compat"),
    "detect_terms_token": document_terms("token"),
    "detect_phrases": document_phrases,
    "detect_term_counts": document_term_counts,
    "detect_built_in": built_in_terms,
    "lexicon_merge_extend": lexicon_merge("extend"),
    "lexicon_merge_replace": lexicon_merge("replace"),
    **{f"filters_{name}": _filtered(name) for name in FILTERS},
    "sort_nulls_last": sorted_providers,
    "display_formats": display_texts,
    "resume_command": resume_commands,
    "dates_and_texts": daily_dates,
}
