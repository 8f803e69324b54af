"""The queries once more, as DuckDB SQL over the same tables.

The SQL states each result directly from the tables: as-of lookups use ASOF
joins, errors use the literal OR join, normalised events are derived from
``events`` without any JSON in between.
"""

from __future__ import annotations

from workload.adapter import FILLERS, LEXICON, PHRASES
from workload.logs import ALIASES, LISTED, PROVIDERS, TERMS
from workload.queries import FILTERS

from sessionmill.operators.lexicon import built_in_rows
from sessionmill.operators.pricing import FIRST_TIER, SECOND_TIER
from sessionmill.plans.filters import Filters


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# ---- the adapters -------------------------------------------------------------------------------------------------

ROWS = """
log AS (
  SELECT event_id, event_type, user_id, value, ts AS stamp, epoch_ms(ts) AS ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    ['pi', 'opencode', 'claude', 'codex', 'gemini'][CAST(user_id % 5 + 1 AS INTEGER)] AS harness,
    's' || user_id || '-' || CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS filename,
    'p' || (user_id % 12) AS project,
    CASE WHEN event_type <> 'signup' THEN 'm' || ((user_id + event_id) % 6) END AS model,
    CASE WHEN event_type <> 'signup' AND (user_id + event_id) % 6 <> 5 THEN 'v' || ((user_id + event_id) % 6 % 3) END AS provider,
    't' || (event_id % 9) AS tool_name,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso
  FROM events
)"""

EVENTS = """
ev_logs AS (
  SELECT harness, filename, project, model AS raw_model, model, provider, '/w/' || project AS session_cwd, ms AS ts,
    CAST(CASE WHEN event_type = 'purchase' AND k % 10 <> 0 THEN value ELSE 0 END AS DOUBLE) AS cost,
    CAST(CASE WHEN event_type = 'purchase' THEN k * 100 ELSE 0 END AS BIGINT) AS in_tok,
    CAST(CASE WHEN event_type = 'purchase' THEN k * 10 ELSE 0 END AS BIGINT) AS out_tok,
    CAST(CASE WHEN event_type = 'purchase' THEN k * 50 ELSE 0 END AS BIGINT) AS cache_tok,
    CAST(event_type = 'view' AS INTEGER) AS is_turn, CAST(event_type = 'signup' AS INTEGER) AS is_user,
    CAST(event_type IN ('click', 'error') AS INTEGER) AS is_tool, CAST(event_type = 'error' AS INTEGER) AS is_error,
    CASE WHEN event_type IN ('click', 'error') THEN tool_name END AS tool
  FROM log
),
ev_chats AS (
  SELECT 'pi' AS harness, 'c' || conv_id AS filename, 'p' || (conv_id % 12) AS project,
    CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 4) END AS raw_model,
    CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 4) END AS model,
    CASE WHEN role = 'assistant' AND conv_id % 4 <> 3 THEN 'v' || (conv_id % 2) END AS provider,
    CAST(NULL AS VARCHAR) AS session_cwd, (turn + 1) * 1000 AS ts, CAST(0 AS DOUBLE) AS cost,
    CAST(0 AS BIGINT) AS in_tok, CAST(0 AS BIGINT) AS out_tok, CAST(0 AS BIGINT) AS cache_tok,
    CAST(role = 'assistant' AS INTEGER) AS is_turn, CAST(role = 'user' AS INTEGER) AS is_user,
    0 AS is_tool, 0 AS is_error, CAST(NULL AS VARCHAR) AS tool
  FROM conversations WHERE role IN ('assistant', 'user')
)"""

ONLY_LOGS = "ev AS (SELECT * FROM ev_logs)"
LOGS_AND_CHATS = "ev AS (SELECT * FROM ev_logs UNION ALL SELECT * FROM ev_chats)"

ROLLUPS = """
turn AS (
  SELECT harness, filename, ts, model, provider FROM (
    SELECT *, row_number() OVER (PARTITION BY harness, filename, ts ORDER BY model DESC, provider DESC NULLS LAST) AS place
    FROM ev WHERE is_turn = 1 AND model <> ''
  ) WHERE place = 1
),
used AS (
  SELECT t.harness, t.filename, t.ts, t.tool, t.is_error, turn.model, turn.provider
  FROM (SELECT * FROM ev WHERE is_tool = 1 AND tool IS NOT NULL) t
  ASOF LEFT JOIN turn ON t.harness = turn.harness AND t.filename = turn.filename AND t.ts >= turn.ts
),
mt AS (
  SELECT harness, filename, model, provider, tool, count(*) AS count, CAST(sum(is_error) AS BIGINT) AS errors
  FROM used WHERE model IS NOT NULL GROUP BY ALL
),
st AS (
  SELECT e.harness, e.filename, min(e.raw_model) AS raw_model, e.model, e.provider,
    CAST(sum(e.is_turn) AS BIGINT) AS turns, sum(e.cost) AS cost, CAST(sum(e.in_tok) AS BIGINT) AS in_tok,
    CAST(sum(e.out_tok) AS BIGINT) AS out_tok, CAST(sum(e.cache_tok) AS BIGINT) AS cache_tok,
    CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS tools, CAST(coalesce(any_value(c.bad), 0) AS BIGINT) AS errors
  FROM ev e
  LEFT JOIN (SELECT harness, filename, model, provider, sum(count) AS n, sum(errors) AS bad FROM mt GROUP BY ALL) c
    ON c.harness = e.harness AND c.filename = e.filename AND c.model = e.model AND c.provider IS NOT DISTINCT FROM e.provider
  WHERE e.model <> '' AND (e.is_turn = 1 OR e.cost <> 0 OR e.in_tok + e.out_tok + e.cache_tok > 0)
  GROUP BY e.harness, e.filename, e.model, e.provider
),
se AS (
  SELECT harness, filename, min(ts) AS start_time, max(ts) AS end_time, (max(ts) - min(ts)) / 1000.0 AS duration_sec,
    min(project) AS project, max(session_cwd) AS cwd, list_sort(list(DISTINCT model) FILTER (WHERE model IS NOT NULL)) AS models,
    sum(cost) AS cost, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok,
    CAST(sum(cache_tok) AS BIGINT) AS cache_tok, count(*) FILTER (WHERE is_user = 1) AS user_turns,
    count(*) FILTER (WHERE is_turn = 1) AS agent_turns, count(*) FILTER (WHERE is_error = 1) AS errors,
    count(tool) AS tool_count, count(*) FILTER (WHERE tool IS NOT NULL AND is_error = 1) AS tool_error_count
  FROM ev WHERE ts > 0 GROUP BY harness, filename
)"""

# ---- term detection ---------------------------------------------------------------------------------------------


def _found(name: str, source: str, key: str, words) -> str:
    """CTEs ending in ``name``(key, pass, start, word): matches of both searches of (key, text) rows."""
    ranked = "|".join(sorted(words, key=lambda w: (-len(w), w)))

    def pieces(number: int, text: str) -> str:
        return (
            f"SELECT {key}, {number} AS pass, string_split(regexp_replace({text}, '\\b({ranked})\\b', "
            f"chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM {name}_low"
        )

    return f"""
{name}_low AS (
  SELECT {key}, low, array_to_string(list_filter(chars, lambda x, i: i = 1 OR x <> chars[i - 1]), '') AS short
  FROM (SELECT {key}, lower(text) AS low, string_split(lower(text), '') AS chars FROM {source} WHERE text <> '')
),
{name}_split AS ({pieces(1, "low")} UNION ALL {pieces(2, "short")} WHERE short <> low),
{name}_parts AS (
  SELECT {key}, pass, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM {name}_split
),
{name}_at AS (
  SELECT {key}, pass, i, split_part(piece, chr(2), 1) AS word,
    sum(strlen(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END)
      OVER (PARTITION BY {key}, pass ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
  FROM {name}_parts
),
{name}_both AS (
  SELECT {key}, pass, CAST(start AS BIGINT) AS start, word,
    row_number() OVER (PARTITION BY {key}, start ORDER BY pass) AS seen
  FROM {name}_at WHERE i > 1
),
{name} AS (SELECT {key}, pass, start, word FROM {name}_both WHERE seen = 1)"""


def _lexicon(rows) -> str:
    values = ", ".join(f"('{w}', '{s}', '{g}')" for w, s, g in rows)
    return f"lexicon AS (SELECT * FROM (VALUES {values}) AS l(word, severity, group_name))"


HITS = (
    "chat AS (SELECT conv_id * 1000000 + turn AS message, conv_id, turn, text FROM conversations WHERE role = 'user'),"
    + _found("found", "chat", "message", [w for w, _, _ in LEXICON])
    + ","
    + _lexicon(LEXICON)
    + """,
raw_hit AS (
  SELECT 'pi' AS harness, 'c' || conv_id AS filename, 'p' || (conv_id % 12) AS project, (turn + 1) * 1000 AS ts,
    f.word, l.group_name, l.severity
  FROM found f JOIN chat USING (message) JOIN lexicon l ON l.word = f.word
),
hit AS (
  SELECT h.*, turn.model, turn.provider FROM raw_hit h
  ASOF LEFT JOIN turn ON h.harness = turn.harness AND h.filename = turn.filename AND h.ts <= turn.ts
)"""
)

LOGS = ",".join((ROWS, EVENTS, ONLY_LOGS, ROLLUPS))
BOTH = ",".join((ROWS, EVENTS, LOGS_AND_CHATS, ROLLUPS))
ALL = BOTH + "," + HITS


# ---- display -----------------------------------------------------------------------------------------------------


def _money(x: str, places: int = 4) -> str:
    return f"printf('$%.{places}f', CAST({x} AS DOUBLE))"


def _human(n: str, largest: str = "B") -> str:
    millions = f"printf('%.1fM', {n} / 1000000.0)"
    top = millions if largest == "M" else f"CASE WHEN {n} < 1000000000 THEN {millions} ELSE printf('%.1fB', {n} / 1000000000.0) END"
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} < 1000000 THEN printf('%.1fK', {n} / 1000.0) ELSE {top} END"


def _breakdown(a: str, b: str, c: str) -> str:
    return f"(({_human(a)}) || ' in / ' || ({_human(b)}) || ' out / ' || ({_human(c)}) || ' cache')"


def _duration(s: str) -> str:
    return (
        f"CASE WHEN {s} <= 0 THEN '-' WHEN {s} < 60 THEN ({s}) || 's' WHEN {s} < 3600 THEN (({s}) // 60) || 'm ' || (({s}) % 60) || 's' "
        f"ELSE (({s}) // 3600) || 'h ' || ((({s}) % 3600) // 60) || 'm' END"
    )


def _percent(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN '0%' ELSE printf('%.1f%%', {a} * 100.0 / {b}) END"


def _ratio(a: str, b: str, places: int, empty: str, prefix: str = "") -> str:
    return f"CASE WHEN {b} = 0 THEN '{prefix}{empty}' ELSE printf('{prefix}%.{places}f', {a} * 1.0 / {b}) END"


def _mood(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'calm' WHEN {n} <= 3 THEN 'irked' WHEN {n} <= 9 THEN 'frustrated' ELSE 'furious' END"


FEEL = "CASE severity WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"

# ---- the questions -----------------------------------------------------------------------------------------------


class Where:
    """Conditions of one filter set, in the shapes the questions need."""

    def __init__(self, f: Filters = Filters()):
        self.f = f

    def row(self, alias: str, *names: str) -> str:
        return " AND ".join(["TRUE", *[f"{alias}.{n} = '{getattr(self.f, n)}'" for n in names if getattr(self.f, n)]])

    def recent(self, alias: str) -> str:
        if not self.f.days:
            return "TRUE"
        return f"epoch_ms({alias}.start_time) >= DATE '{self.f.as_of}' - INTERVAL {self.f.days} DAY"

    def has(self, alias: str, table: str, *names: str) -> str:
        return " AND ".join(["TRUE", *[
            f"EXISTS (SELECT 1 FROM {table} x WHERE x.harness = {alias}.harness AND x.filename = {alias}.filename "
            f"AND x.{n} = '{getattr(self.f, n)}')"
            for n in names if getattr(self.f, n)
        ]])

    def session(self, alias: str) -> str:
        if not (self.f.days or self.f.project):
            return "TRUE"
        return (
            f"EXISTS (SELECT 1 FROM se x WHERE x.harness = {alias}.harness AND x.filename = {alias}.filename "
            f"AND {self.recent('x')} AND {self.row('x', 'project')})"
        )

    def same_provider_tool(self, alias: str) -> str:
        """The tool was used by the row's model at the row's provider; a NULL provider never matches."""
        if not self.f.tool:
            return "TRUE"
        return (
            f"EXISTS (SELECT 1 FROM mt x WHERE x.harness = {alias}.harness AND x.filename = {alias}.filename "
            f"AND x.tool = '{self.f.tool}' AND x.model = {alias}.model AND x.provider = {alias}.provider)"
        )


def _content_sessions(w: Where) -> str:
    return (
        f"SELECT * FROM se s WHERE {w.recent('s')} AND {w.row('s', 'project', 'filename')} AND {w.has('s', 'ev', 'harness', 'tool')} "
        f"AND {w.has('s', 'st', 'provider', 'model')}"
    )


def _usage(w: Where) -> str:
    return f"SELECT * FROM st s WHERE {w.row('s', 'filename', 'harness', 'provider', 'model')} AND {w.session('s')}"


def _hit_rows(w: Where) -> str:
    return (
        f"SELECT h.* FROM hit h JOIN se s ON s.harness = h.harness AND s.filename = h.filename "
        f"WHERE {w.recent('s')} AND {w.row('s', 'project', 'filename')} AND {w.row('h', 'harness', 'provider', 'model')} "
        f"AND {w.has('h', 'mt', 'tool')}"
    )


def summary(w: Where) -> str:
    return f"""
  SELECT *, {_money('total_spend', 2)} AS total_spend_display, {_human('total_tokens')} AS total_tokens_display,
    {_breakdown('in_tokens', 'out_tokens', 'cache_tokens')} AS token_breakdown_display,
    {_percent('multi_model_sessions', 'sessions')} AS multi_model_sessions_pct,
    {_duration('avg_duration')} AS avg_duration_display, {_human('tool_calls')} AS tool_calls_display,
    {_human('tool_errors')} AS tool_errors_display, {_percent('tool_errors', 'tool_calls')} AS tool_error_pct,
    {_ratio('total_spend', 'sessions', 2, '0.00', '$')} AS avg_cost_per_session_display,
    agent_turns + user_turns AS total_turns, {_human('per_turn')} AS avg_tokens_per_turn_display,
    {_ratio('tool_calls', 'sessions', 1, '0')} AS avg_tools_per_session_display
  FROM (
    SELECT *, CASE WHEN agent_turns + user_turns = 0 THEN 0 ELSE CAST(total_tokens / (agent_turns + user_turns) AS BIGINT) END AS per_turn
    FROM (
      SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) AS total_spend, CAST(coalesce(sum(in_tok + out_tok), 0) AS BIGINT) AS total_tokens,
        CAST(coalesce(sum(in_tok), 0) AS BIGINT) AS in_tokens, CAST(coalesce(sum(out_tok), 0) AS BIGINT) AS out_tokens,
        CAST(coalesce(sum(cache_tok), 0) AS BIGINT) AS cache_tokens, count(DISTINCT filename) AS sessions,
        CAST(coalesce(avg(duration_sec) FILTER (WHERE duration_sec > 0 AND duration_sec < 86400), 0) AS BIGINT) AS avg_duration,
        count(*) FILTER (WHERE duration_sec > 0 AND duration_sec < 86400) AS timed_sessions,
        CAST(coalesce(sum(tool_count), 0) AS BIGINT) AS tool_calls, CAST(coalesce(sum(tool_error_count), 0) AS BIGINT) AS tool_errors,
        CAST(coalesce(sum(agent_turns), 0) AS BIGINT) AS agent_turns, CAST(coalesce(sum(user_turns), 0) AS BIGINT) AS user_turns,
        count(*) FILTER (WHERE len(models) > 1) AS multi_model_sessions
      FROM ({_content_sessions(w)})
    )
  )"""


def harnesses(w: Where, key: str = "harness") -> str:
    turns = "CAST(sum(turns) AS BIGINT) AS turns," if key == "harness" else ""
    return f"""
  SELECT *, {_money('spend')} AS spend_display, {_human('tokens')} AS tokens_display FROM (
    SELECT {key}, sum(cost) AS spend, CAST(sum(in_tok + out_tok + cache_tok) AS BIGINT) AS tokens, {turns}
      CAST(sum(tools) AS BIGINT) AS tools, CAST(sum(errors) AS BIGINT) AS errors
    FROM ({_usage(w)}) u WHERE {w.has('u', 'ev', 'tool')} GROUP BY {key}
  )"""


def models(w: Where) -> str:
    free = "cost = 0 AND in_tok + out_tok + cache_tok > 0"
    return f"""
  SELECT model, coalesce(provider, 'unknown') AS provider, spend, {_money('spend')} AS spend_display, sessions,
    spend / sessions AS avg_cost_per_session, {_money('spend / sessions')} AS avg_cost_per_session_display,
    tokens, {_human('tokens')} AS tokens_display, unpriced_tokens, {_human('unpriced_tokens')} AS unpriced_tokens_display,
    unpriced_sessions, tools, errors
  FROM (
    SELECT model, provider, sum(cost) AS spend, count(DISTINCT harness || ':' || filename) AS sessions,
      CAST(sum(in_tok + out_tok + cache_tok) AS BIGINT) AS tokens,
      CAST(coalesce(sum(in_tok + out_tok + cache_tok) FILTER (WHERE {free}), 0) AS BIGINT) AS unpriced_tokens,
      count(DISTINCT harness || ':' || filename) FILTER (WHERE {free}) AS unpriced_sessions,
      CAST(sum(tools) AS BIGINT) AS tools, CAST(sum(errors) AS BIGINT) AS errors
    FROM ({_usage(w)}) u WHERE {w.same_provider_tool('u')} GROUP BY model, provider
  )"""


def projects(w: Where) -> str:
    return f"""
  SELECT *, {_money('spend')} AS spend_display, {_duration('avg_duration')} AS avg_duration_display FROM (
    SELECT project, sum(cost) AS spend, count(*) AS sessions,
      CAST(coalesce(avg(duration_sec) FILTER (WHERE duration_sec > 0 AND duration_sec < 86400), 0) AS BIGINT) AS avg_duration
    FROM ({_content_sessions(w)}) GROUP BY project
  )"""


def tools(w: Where, keys: str = "tool") -> str:
    shown = "tool" if keys == "tool" else "model, coalesce(provider, 'unknown') AS provider, tool"
    return f"""
  SELECT {shown}, count, errors, {_percent('errors', 'count')} AS error_pct FROM (
    SELECT {keys}, CAST(sum(count) AS BIGINT) AS count, CAST(sum(errors) AS BIGINT) AS errors FROM mt m
    WHERE {w.row('m', 'filename', 'harness', 'provider', 'model', 'tool')} AND {w.session('m')} GROUP BY {keys}
  )"""


def session_count(w: Where) -> str:
    return (
        f"SELECT count(*) AS sessions FROM se s WHERE {w.recent('s')} AND {w.row('s', 'project', 'filename', 'harness')} "
        f"AND {w.has('s', 'st', 'provider', 'model')} AND {w.has('s', 'ev', 'tool')}"
    )


def timeline(w: Where) -> str:
    day = "CAST(CAST(epoch_ms(s.start_time) AS DATE) AS VARCHAR)"
    joined = "JOIN day_se s ON s.harness = x.harness AND s.filename = x.filename"
    return f"""
  SELECT date, cost, {_money('cost', 2)} AS cost_display, tokens, {_human('tokens')} AS tokens_display,
    tool_calls, {_human('tool_calls', 'M')} AS tool_calls_display, tool_errors, {_human('tool_errors', 'M')} AS tool_errors_display,
    profanity_hits, {_human('profanity_hits', 'M')} AS profanity_hits_display, feel_score, {_mood('feel_score')} AS feel_display
  FROM (
    SELECT date, coalesce(sum(cost), 0) AS cost, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
      CAST(coalesce(sum(calls), 0) AS BIGINT) AS tool_calls, CAST(coalesce(sum(bad), 0) AS BIGINT) AS tool_errors,
      CAST(coalesce(sum(hits), 0) AS BIGINT) AS profanity_hits, CAST(coalesce(sum(feel), 0) AS BIGINT) AS feel_score
    FROM (
      SELECT {day} AS date, x.cost, x.in_tok + x.out_tok + x.cache_tok AS tokens, NULL AS calls, NULL AS bad, NULL AS hits, NULL AS feel
      FROM st x {joined} WHERE {w.row('x', 'provider', 'model')} AND {_usage_tool(w)}
      UNION ALL
      SELECT {day}, NULL, NULL, x.count, x.errors, NULL, NULL FROM mt x {joined} WHERE {w.row('x', 'provider', 'model', 'tool')}
      UNION ALL
      SELECT {day}, NULL, NULL, NULL, NULL, 1, {FEEL} FROM hit x {joined} WHERE {w.row('x', 'provider', 'model')} AND {_hit_tool(w)}
    ) GROUP BY date
  )"""


def _usage_tool(w: Where) -> str:
    if not w.f.tool:
        return "TRUE"
    return (
        f"EXISTS (SELECT 1 FROM mt y WHERE y.harness = x.harness AND y.filename = x.filename AND y.tool = '{w.f.tool}' "
        "AND y.model = x.model AND y.provider IS NOT DISTINCT FROM x.provider)"
    )


def _hit_tool(w: Where) -> str:
    if not w.f.tool:
        return "TRUE"
    return (
        f"EXISTS (SELECT 1 FROM mt y WHERE y.harness = x.harness AND y.filename = x.filename AND y.tool = '{w.f.tool}' "
        "AND (x.model IS NULL OR y.model = x.model) AND (x.provider IS NULL OR y.provider IS NOT DISTINCT FROM x.provider))"
    )


def day_sessions(w: Where) -> str:
    return f"day_se AS (SELECT * FROM se s WHERE {w.recent('s')} AND {w.row('s', 'project', 'filename', 'harness')})"


def term_groups(w: Where) -> str:
    return (
        f"SELECT group_name, min(severity) AS severity, count(*) AS count FROM ({_hit_rows(w)}) GROUP BY group_name "
        "ORDER BY count DESC, group_name LIMIT 20"
    )


def term_models(w: Where) -> str:
    return f"""
  SELECT model, coalesce(provider, 'unknown') AS provider, count(*) AS count, count(DISTINCT harness || ':' || filename) AS sessions
  FROM ({_hit_rows(w)}) f WHERE model <> '' GROUP BY f.model, f.provider ORDER BY count DESC, f.model, 2 LIMIT 20"""


def term_harnesses(w: Where) -> str:
    return f"SELECT harness, count(*) AS count, count(DISTINCT filename) AS sessions FROM ({_hit_rows(w)}) GROUP BY harness"


def term_pairs(w: Where) -> str:
    return f"""
  SELECT a.*, {_mood('feel_score')} AS feel_display, CAST(t.user_turns AS BIGINT) AS user_turns,
    {_ratio('a.count', 't.user_turns', 2, '0.00')} AS swears_per_user_turn_display
  FROM (
    SELECT harness, coalesce(model, 'unknown') AS model, coalesce(provider, 'unknown') AS provider, count(*) AS count,
      count(*) FILTER (WHERE severity = 'strong') AS strong_count, count(*) FILTER (WHERE severity = 'moderate') AS moderate_count,
      count(*) FILTER (WHERE severity = 'mild') AS mild_count, CAST(sum({FEEL}) AS BIGINT) AS feel_score,
      count(DISTINCT filename) AS sessions
    FROM pair_hit GROUP BY 1, 2, 3
  ) a JOIN (
    SELECT harness, model, provider, sum(user_turns) AS user_turns FROM (
      SELECT DISTINCT harness, filename, coalesce(model, 'unknown') AS model, coalesce(provider, 'unknown') AS provider, user_turns FROM pair_hit
    ) GROUP BY 1, 2, 3
  ) t ON t.harness = a.harness AND t.model = a.model AND t.provider = a.provider"""


def pair_hits(w: Where) -> str:
    return f"""pair_hit AS (
  SELECT x.*, s.user_turns FROM hit x JOIN se s ON s.harness = x.harness AND s.filename = x.filename
  WHERE {w.recent('s')} AND {w.row('s', 'project')} AND {w.row('x', 'filename', 'harness', 'provider', 'model')} AND {_hit_tool(w)}
)"""


def term_summary(w: Where) -> str:
    return f"""
  SELECT *, {_ratio('total_swears', 'user_turns', 2, '0.00')} AS swears_per_user_turn_display,
    {_ratio('total_swears', 'sessions', 2, '0.00')} AS swears_per_session_display,
    {_percent('sessions_with_swears', 'sessions')} AS sessions_with_swears_pct
  FROM (
    SELECT (SELECT count(*) FROM sum_hit) AS total_swears, (SELECT count(*) FROM sum_hit WHERE severity = 'strong') AS strong_swears,
      (SELECT count(DISTINCT harness || ':' || filename) FROM sum_hit) AS sessions_with_swears, (SELECT count(*) FROM sum_se) AS sessions,
      (SELECT CAST(coalesce(sum(user_turns), 0) AS BIGINT) FROM sum_se) AS user_turns,
      coalesce((SELECT group_name FROM sum_hit GROUP BY group_name ORDER BY count(*) DESC, group_name LIMIT 1), '') AS top_group
  )"""


def summary_inputs(w: Where) -> str:
    return f"""sum_se AS (
  SELECT * FROM se s WHERE {w.recent('s')} AND {w.row('s', 'project', 'filename', 'harness')}
    AND {w.has('s', 'st', 'provider', 'model')} AND {w.has('s', 'mt', 'tool')}
),
sum_hit AS (
  SELECT h.* FROM hit h JOIN sum_se s ON s.harness = h.harness AND s.filename = h.filename WHERE {w.row('h', 'provider', 'model')}
)"""


def stacked(w: Where) -> str:
    def rows(question: str, sql: str, key: str, amount: str, number: str) -> str:
        return f"SELECT '{question}' AS question, {key} AS key, round(CAST({amount} AS DOUBLE), 4) AS amount, CAST({number} AS BIGINT) AS number FROM ({sql})"

    pair = "model || '/' || provider"
    parts = [
        rows("summary", summary(w), "'all'", "total_spend", "sessions * 1000003 + tool_calls"),
        rows("harnesses", harnesses(w), "harness", "spend", "tokens + turns * 7 + tools * 3 + errors"),
        rows("providers", harnesses(w, "provider"), "coalesce(provider, '-')", "spend", "tokens + tools * 3 + errors"),
        rows("models", models(w), pair, "spend", "tokens + sessions * 7 + tools * 3 + errors"),
        rows("projects", projects(w), "project", "spend", "sessions * 1000003 + avg_duration"),
        rows("tools", tools(w), "tool", "errors", "count"),
        rows("model_tools", tools(w, "model, provider, tool"), f"{pair} || '/' || tool", "errors", "count"),
        rows("sessions", session_count(w), "'all'", "0", "sessions"),
        rows("timeline", timeline(w), "date", "cost", "tokens + tool_calls * 3 + tool_errors * 5 + profanity_hits * 7 + feel_score * 11"),
        rows("groups", term_groups(w), "group_name", "0", "count"),
        rows("term_models", term_models(w), pair, "sessions", "count"),
        rows("term_harnesses", term_harnesses(w), "harness", "sessions", "count"),
        rows("term_pairs", term_pairs(w), f"harness || '/' || {pair}", "feel_score", "count + sessions * 1000 + user_turns * 1000000"),
        rows("term_summary", term_summary(w), "top_group", "sessions_with_swears",
             "total_swears + strong_swears * 1000 + sessions * 1000000 + user_turns * 1000000000"),
    ]
    inputs = ",".join((ALL, day_sessions(w), pair_hits(w), summary_inputs(w)))
    return f"WITH {inputs} " + " UNION ALL ".join(parts)


# ---- normalised sources -----------------------------------------------------------------------------------------

PRICES = f"""
offer AS (
  SELECT {_list(PROVIDERS)}[CAST(p_partkey % 8 + 1 AS INTEGER)] AS provider, {_list(LISTED)}[CAST(p_partkey % 6 + 1 AS INTEGER)] AS model,
    p_name, p_size / 10 AS input, CAST(p_size AS DOUBLE) AS output, p_size / 100 AS cache_read,
    CASE WHEN p_partkey % 6 < 2 THEN p_size / 5 END AS cache_write
  FROM part
),
listed AS (
  SELECT model, (array_agg(provider ORDER BY CASE WHEN provider IN {FIRST_TIER} THEN 1 WHEN provider IN {SECOND_TIER} THEN 2 ELSE 3 END, provider))[1] AS provider,
    max(p_name) AS friendly_name, max(input) AS input_cost, max(output) AS output_cost, max(cache_read) AS cache_cost,
    max(cache_write) AS cache_write_cost
  FROM offer GROUP BY model
),
alias AS (SELECT * FROM (VALUES {", ".join(map(str, ALIASES))}) AS a(raw_model, api_model)),
price AS (
  SELECT coalesce(a.raw_model, l.model) AS model, l.provider, l.friendly_name, l.input_cost, l.output_cost, l.cache_cost, l.cache_write_cost
  FROM listed l JOIN alias a ON a.api_model = l.model
  UNION ALL
  SELECT * FROM listed WHERE model NOT IN (SELECT raw_model FROM alias)
)"""


def _cost(i: str, o: str, r: str, w: str | None = None) -> str:
    write = f" + {w} * coalesce(p.cache_write_cost, p.input_cost, 0)" if w else ""
    return f"(({i}) * coalesce(p.input_cost, 0){write} + ({o}) * coalesce(p.output_cost, 0) + ({r}) * coalesce(p.cache_cost, 0)) / 1000000.0"


def _event(harness: str, **columns: str) -> str:
    """The 17 event columns with their defaults."""
    columns.setdefault("raw_model", columns.get("model", "NULL"))
    text = ("filename", "project", "raw_model", "model", "provider", "session_cwd")
    whole = ("in_tok", "out_tok", "cache_tok")
    flags = ("is_turn", "is_user", "is_tool", "is_error")
    listed = [f"'{harness}' AS harness"]
    listed += [f"CAST({columns.get(n, 'NULL')} AS VARCHAR) AS {n}" for n in text]
    listed += [f"CAST({columns['ts']} AS BIGINT) AS ts", f"round(CAST({columns.get('cost', '0')} AS DOUBLE), 9) AS cost"]
    listed += [f"CAST({columns.get(n, '0')} AS BIGINT) AS {n}" for n in whole]
    listed += [f"CAST({columns.get(n, '0')} AS INTEGER) AS {n}" for n in flags]
    listed += [f"CAST({columns.get('tool', 'NULL')} AS VARCHAR) AS tool"]
    return ", ".join(listed)


def _last(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


PI_PROJECT = "coalesce('p' || substr(f.cwd, 5), 'w-' || project)"
PI_NAME = "'/logs/--w-' || project || '--/' || filename || '.jsonl'"


def normalize_pi() -> str:
    bought = "event_type = 'purchase'"
    priced = _cost("k * 100", "k * 10", "k * 50")
    there = "k % 13 <> 0"
    result = f"{there} AND event_type IN ('click', 'error')"
    return f"""
WITH {ROWS}, {PRICES},
kept AS (
  SELECT *, {PI_NAME} AS path, CASE WHEN event_id % 5 = 0 THEN '/w/' || project END AS cwd FROM log WHERE {there} OR k % 11 = 0
),
f AS (SELECT path, max(cwd) AS cwd FROM kept GROUP BY path)
SELECT {_event(
        "pi", filename="r.path", project="coalesce(string_split(f.cwd, '/')[-1], 'w-' || r.project)",
        model=f"CASE WHEN {there} THEN r.model END", provider=f"coalesce(CASE WHEN {there} THEN r.provider END, 'unknown')",
        session_cwd="r.cwd", ts="r.ms",
        cost=f"CASE WHEN NOT ({bought} AND {there}) THEN 0 WHEN k % 10 = 0 OR k % 7 = 0 OR value = 0 THEN {priced} ELSE value END",
        in_tok=f"CASE WHEN {bought} AND {there} THEN k * 100 ELSE 0 END", out_tok=f"CASE WHEN {bought} AND {there} THEN k * 10 ELSE 0 END",
        cache_tok=f"CASE WHEN {bought} AND {there} THEN k * 50 ELSE 0 END",
        is_turn=f"{there} AND event_type IN ('view', 'purchase')", is_user=f"{there} AND event_type = 'signup'",
        is_tool=f"{result} AND k % 9 <> 0", is_error=f"{there} AND event_type = 'error'",
        tool=f"CASE WHEN {result} AND k % 9 <> 0 THEN tool_name END",
    )}
FROM kept r JOIN f USING (path) LEFT JOIN price p ON p.model = r.model"""


def messages_pi() -> str:
    text = "CASE WHEN k % 2 = 1 THEN 'n ' || k ELSE '[{\"type\":\"text\",\"text\":\"n ' || k || '\"}]' END"
    return f"""
WITH {ROWS},
said AS (
  SELECT *, {PI_NAME} AS path, CASE WHEN event_id % 5 = 0 THEN '/w/' || project END AS cwd FROM log WHERE k % 13 <> 0 AND event_type = 'signup'
),
f AS (SELECT path, max(cwd) AS cwd FROM said GROUP BY path)
SELECT 'pi' AS harness, path AS filename, coalesce(string_split(f.cwd, '/')[-1], 'w-' || project) AS project, r.cwd AS session_cwd,
  ms AS ts, {text} AS text
FROM said r JOIN f USING (path)"""


OPENCODE = f"""
ses AS (SELECT DISTINCT filename AS id, '/w/' || project AS directory FROM log WHERE user_id % 7 <> 0),
msg AS (
  SELECT *, event_type = 'signup' AS by_user, CASE WHEN event_type <> 'signup' AND k % 2 = 0 THEN '/o/' || project END AS own
  FROM log WHERE event_type IN ('view', 'purchase', 'signup')
)"""


def normalize_opencode() -> str:
    cwd = "coalesce(m.own, s.directory)"
    project = f"coalesce({_last(cwd)}, 'opencode')"
    priced = _cost("m.k * 100", "m.k * 10", "m.k * 50", "m.k * 5")
    provider = "coalesce(m.provider, p.provider, 'opencode')"
    return f"""
WITH {ROWS}, {PRICES}, {OPENCODE}
SELECT {_event("opencode", filename="m.filename", project=project, model="m.model", provider=provider, session_cwd=cwd, ts="m.ms",
               cost=f"CASE WHEN m.k % 3 = 1 AND m.value <> 0 THEN m.value ELSE {priced} END", in_tok="m.k * 105", out_tok="m.k * 10",
               cache_tok="m.k * 50", is_turn="1")}
FROM msg m LEFT JOIN ses s ON s.id = m.filename LEFT JOIN price p ON p.model = m.model WHERE NOT m.by_user
UNION ALL
SELECT {_event("opencode", filename="m.filename", project=_last("s.directory"), session_cwd="s.directory", ts="m.ms", is_user="1")}
FROM msg m JOIN ses s ON s.id = m.filename WHERE m.by_user
UNION ALL
SELECT {_event("opencode", filename="t.filename", project=project, model="m.model", provider=provider, session_cwd=cwd, ts="t.ms",
               is_tool="1", is_error="t.event_type = 'error'", tool="t.tool_name")}
FROM log t JOIN msg m ON m.event_id = t.event_id - t.event_id % 4 LEFT JOIN ses s ON s.id = t.filename LEFT JOIN price p ON p.model = m.model
WHERE t.event_type IN ('click', 'error') AND t.k % 9 <> 0"""


def messages_opencode() -> str:
    return f"""
WITH {ROWS}, {OPENCODE}
SELECT 'opencode' AS harness, m.filename, {_last("s.directory")} AS project, s.directory AS session_cwd, m.ms AS ts, 'n ' || t.k AS text
FROM log t JOIN msg m ON m.event_id = t.event_id - t.event_id % 4 JOIN ses s ON s.id = m.filename
WHERE m.by_user AND t.event_type NOT IN ('click', 'error') AND t.k % 6 <> 0"""


CLAUDE = """
rec AS (
  SELECT *, '/c/' || project || '/' || filename || '.jsonl' AS path, event_type IN ('view', 'purchase') AS spoken,
    'a' || (k % 20) AS uuid, CASE WHEN k % 10 = 0 THEN 'a' || (k % 20) WHEN k % 5 <> 0 THEN 'a' || ((k + 1) % 20) END AS answers
  FROM log
),
f AS (SELECT path, max(CASE WHEN event_id % 5 = 0 THEN '/w/' || project END) AS cwd, any_value(project) AS folder FROM rec GROUP BY path),
tu AS (
  SELECT path, iso, ms, model, uuid, 'u' || (k % 10) AS use_id, tool_name AS tool FROM rec WHERE event_type = 'view'
  UNION
  SELECT path, iso, ms, model, uuid, NULL, CASE WHEN k % 2 = 0 THEN 'search' ELSE 'server_tool_use' END FROM rec WHERE event_type = 'view'
),
tr AS (
  SELECT path, 'u' || (k % 10) AS use_id, answers, CAST(event_type = 'error' AS INTEGER) AS bad FROM rec WHERE event_type IN ('click', 'error')
  UNION ALL
  SELECT path, 'u' || ((k + 1) % 10), answers, 1 FROM rec WHERE event_type = 'error' AND k % 4 = 0
),
te AS (
  SELECT tu.path, tu.iso, tu.ms, tu.model, tu.uuid, tu.use_id, tu.tool, coalesce(max(tr.bad), 0) AS is_error
  FROM tu LEFT JOIN tr ON tr.path = tu.path AND (tr.use_id = tu.use_id OR tr.answers = tu.uuid)
  GROUP BY tu.path, tu.iso, tu.ms, tu.model, tu.uuid, tu.use_id, tu.tool
)"""
CLAUDE_PROJECT = "coalesce(string_split(f.cwd, '/')[-1], f.folder)"


def tool_errors() -> str:
    return f"WITH {ROWS}, {CLAUDE} SELECT path AS filename, iso AS timestamp, model, uuid, use_id, tool, CAST(is_error AS INTEGER) AS is_error FROM te"


def normalize_claude() -> str:
    shared = {"provider": "'anthropic'", "session_cwd": "f.cwd", "project": CLAUDE_PROJECT}
    # 5 + 1 + 2 = 8 cache-creation tokens per k are added to 100 fresh ones.
    priced = _cost("k * 100", "k * 10", "k * 50", "k * 8")
    recorded = f"CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN value ELSE {priced} END"
    return f"""
WITH {ROWS}, {PRICES}, {CLAUDE}
SELECT {_event("claude", filename="r.path", model="r.model", ts="ms", cost=recorded, in_tok="k * 108", out_tok="k * 10", cache_tok="k * 50",
               is_turn="1", **shared)}
FROM rec r JOIN f ON f.path = r.path LEFT JOIN price p ON p.model = r.model WHERE spoken
UNION ALL
SELECT {_event("claude", filename="r.path", ts="ms", is_user="1", **shared)}
FROM rec r JOIN f ON f.path = r.path WHERE event_type = 'signup' AND k % 17 <> 0
UNION ALL
SELECT {_event("claude", filename="t.path", model="t.model", ts="ms", is_tool="1", is_error="t.is_error", tool="t.tool", **shared)}
FROM te t JOIN f ON f.path = t.path"""


def messages_claude() -> str:
    return f"""
WITH {ROWS}, {CLAUDE}
SELECT 'claude' AS harness, r.path AS filename, {CLAUDE_PROJECT} AS project, f.cwd AS session_cwd, ms AS ts,
  CASE WHEN k % 8 = 0 THEN 'null' ELSE '[n ' || k || ']' END AS text
FROM rec r JOIN f ON f.path = r.path WHERE event_type = 'signup' AND k % 17 <> 0"""


CODEX = """
rec AS (SELECT *, '/x/' || filename || '.jsonl' AS path FROM log),
f AS (
  SELECT path, max(CASE WHEN event_type = 'signup' THEN '/w/' || project END) AS cwd,
    max(CASE WHEN event_type = 'signup' THEN provider END) AS from_meta, max(CASE WHEN event_type = 'view' THEN model END) AS model
  FROM rec GROUP BY path
)"""


def normalize_codex() -> str:
    shared = {
        "filename": "r.path", "project": f"coalesce({_last('f.cwd')}, 'codex')", "model": "f.model",
        "provider": "coalesce(f.from_meta, p.provider, 'codex')", "session_cwd": "f.cwd", "ts": "ms",
    }
    fresh = "greatest(k * 10 - 300, 0)"
    joins = "FROM rec r JOIN f ON f.path = r.path LEFT JOIN price p ON p.model = f.model"
    return f"""
WITH {ROWS}, {PRICES}, {CODEX}
SELECT {_event("codex", is_turn="event_type = 'click' AND k % 2 = 1", is_user="event_type = 'click' AND k % 2 = 0", **shared)}
{joins} WHERE event_type IN ('signup', 'click')
UNION ALL
SELECT {_event("codex", cost=_cost(fresh, "k", "300"), in_tok=fresh, out_tok="k", cache_tok="300", **shared)}
{joins} WHERE event_type = 'purchase' AND k % 4 <> 0"""


def messages_codex() -> str:
    return f"""
WITH {ROWS}, {CODEX}
SELECT 'codex' AS harness, r.path AS filename, coalesce({_last('f.cwd')}, 'codex') AS project, f.cwd AS session_cwd, ms AS ts, 'n ' || k AS text
FROM rec r JOIN f ON f.path = r.path WHERE event_type = 'click' AND k % 2 = 0 AND k % 8 NOT IN (0, 2)"""


GEMINI_NAME = "'/g/' || project || '/chats/' || r.filename || '.json'"


def normalize_gemini() -> str:
    shared = {"filename": GEMINI_NAME, "project": "project", "ts": "ms"}
    provider = "coalesce(p.provider, 'google')"
    cost = f"CASE WHEN r.model IS NOT NULL THEN {_cost('k * 100', 'k * 10', 'k * 50')} ELSE 0 END"
    called = "FROM log r LEFT JOIN listed p ON p.model = r.model WHERE event_type IN ('click', 'error')"
    return f"""
WITH {ROWS}, {PRICES}
SELECT {_event("gemini", provider="'google'", is_user="1", **shared)} FROM log r
UNION ALL
SELECT {_event("gemini", model="r.model", provider=provider, cost=cost, in_tok="k * 100", out_tok="k * 10", cache_tok="k * 50", is_turn="1", **shared)}
FROM log r LEFT JOIN listed p ON p.model = r.model WHERE k % 12 <> 0
UNION ALL
SELECT {_event("gemini", model="r.model", provider=provider, is_tool="1", is_error="event_type = 'error'", tool="tool_name", **shared)} {called}
UNION ALL
SELECT {_event("gemini", model="r.model", provider=provider, is_tool="1", tool="'shell'", **shared)} {called} AND k % 2 = 0"""


def messages_gemini() -> str:
    return f"""
WITH {ROWS}
SELECT 'gemini' AS harness, {GEMINI_NAME} AS filename, project, CAST(NULL AS VARCHAR) AS session_cwd, ms AS ts, 'n ' || k AS text FROM log r"""


# ---- the remaining queries --------------------------------------------------------------------------------------


def _rounded(sql: str, prefix: str, **places: int) -> str:
    changed = ", ".join(f"round({c}, {n}) AS {c}" for c, n in places.items())
    return f"WITH {prefix} SELECT * REPLACE ({changed}) FROM ({sql})" if places else f"WITH {prefix} SELECT * FROM ({sql})"


def _json_counts(value: str) -> str:
    return f"'{{' || string_agg('\"' || tool || '\":' || {value}, ',' ORDER BY tool) || '}}'"


def _nested(displayed: bool = True) -> str:
    """The nested columns of a session as text, one table each; with or without the texts made of costs."""
    share = _percent("errors", "tools")
    shown = (
        f"{_money('cost')}, {_breakdown('in_tok', 'out_tok', 'cache_tok')}, {share}, "
        f"{_ratio('cost', 'turns', 4, '0.0000', '$')}, {_ratio('cost', 'tools', 4, '0.0000', '$')}"
    )
    stats = (
        "concat_ws('|', model, coalesce(provider, '-'), turns, in_tok, out_tok, cache_tok, tools, errors, "
        f"{shown if displayed else share})"
    )
    pairs = f"concat_ws('|', model, tool, count, errors, {_percent('errors', 'count')})"
    return f"""
pair AS (SELECT harness, filename, string_agg(t, ';' ORDER BY t) AS text FROM (SELECT harness, filename, {pairs} AS t FROM mt) GROUP BY ALL),
stat AS (SELECT harness, filename, string_agg(t, ';' ORDER BY t) AS text FROM (SELECT harness, filename, {stats} AS t FROM st) GROUP BY ALL)"""


def sessions(logs: str = LOGS, displayed: bool = True, places: int = 4) -> str:
    return f"""
WITH {logs},
per_tool AS (SELECT harness, filename, tool, count(*) AS n, sum(is_error) AS bad FROM ev WHERE tool IS NOT NULL GROUP BY ALL),
maps AS (SELECT harness, filename, {_json_counts('n')} AS good, {_json_counts('bad')} AS bad FROM per_tool GROUP BY ALL),
{_nested(displayed)}
SELECT s.harness, s.filename, start_time, end_time, CAST(duration_sec AS DOUBLE) AS duration_sec, project, cwd,
  array_to_string(models, ',') AS models, round(cost, {places}) AS cost, in_tok, out_tok, cache_tok, user_turns, agent_turns, errors, tool_count,
  tool_error_count, coalesce(maps.good, '{{}}') AS tool_breakdown, coalesce(maps.bad, '{{}}') AS tool_error_breakdown,
  coalesce(pair.text, '') AS model_tool_breakdown, coalesce(stat.text, '') AS model_stats
FROM se s LEFT JOIN maps USING (harness, filename) LEFT JOIN pair USING (harness, filename) LEFT JOIN stat USING (harness, filename)"""


def _resume(harness: str, name: str, cwd: str) -> str:
    quoted = f"'\"' || {name} || '\"'"
    return (
        f"CASE {harness} WHEN 'pi' THEN 'pi --session ' || {quoted} WHEN 'opencode' THEN CASE WHEN {cwd} IS NULL THEN "
        f"'opencode --session ' || {quoted} ELSE 'opencode \"' || {cwd} || '\" --session ' || {quoted} END "
        f"WHEN 'codex' THEN 'codex resume ' || {quoted} WHEN 'gemini' THEN 'gemini --resume ' || {quoted} ELSE 'claude --resume ' || {quoted} END"
    )


LABEL = (
    "CASE harness WHEN 'pi' THEN 'Resume in Pi' WHEN 'opencode' THEN 'Resume in OpenCode' WHEN 'codex' THEN 'Resume in Codex' "
    "WHEN 'gemini' THEN 'Resume in Gemini' ELSE 'Resume in Claude' END"
)


def session_list() -> str:
    return f"""
WITH {LOGS},
per_tool AS (SELECT harness, filename, tool, count(*) AS n, sum(is_error) AS bad FROM ev WHERE tool IS NOT NULL GROUP BY ALL),
maps AS (SELECT harness, filename, {_json_counts('n')} AS good, {_json_counts('bad')} AS bad FROM per_tool GROUP BY ALL),
{_nested()},
base AS (
  SELECT *, in_tok + out_tok + cache_tok AS total_tokens, date_diff('second', epoch_ms(start_time), epoch_ms(end_time)) AS duration_sec_calc
  FROM se ORDER BY total_tokens DESC, start_time DESC, harness, filename LIMIT 100
)
SELECT b.harness, b.filename, strftime(epoch_ms(start_time), '%Y-%m-%dT%H:%M:%S.%f') AS start_time_str,
  strftime(epoch_ms(end_time), '%Y-%m-%dT%H:%M:%S.%f') AS end_time_str, duration_sec_calc, project, cwd, round(cost, 4) AS cost,
  in_tok, out_tok, cache_tok, total_tokens, user_turns, agent_turns, user_turns + agent_turns AS total_turns, errors, tool_count,
  tool_error_count, coalesce(maps.good, '{{}}') AS tool_breakdown_json, coalesce(maps.bad, '{{}}') AS tool_error_breakdown_json,
  coalesce(pair.text, '') AS model_tool_breakdown_json, coalesce(stat.text, '') AS model_stats_json,
  CASE WHEN models IS NULL THEN '[]' ELSE '["' || array_to_string(models, '","') || '"]' END AS models_json,
  {_money('cost')} AS cost_display, {_human('total_tokens')} AS total_tokens_display,
  {_breakdown('in_tok', 'out_tok', 'cache_tok')} AS token_breakdown_display, {_duration('duration_sec_calc')} AS duration_display,
  {_percent('tool_error_count', 'tool_count')} AS tool_error_pct,
  {_resume('b.harness', "CASE b.harness WHEN 'codex' THEN b.filename ELSE b.filename END", 'cwd')} AS resume_command,
  {LABEL.replace('CASE harness', 'CASE b.harness')} AS resume_label
FROM base b LEFT JOIN maps USING (harness, filename) LEFT JOIN pair USING (harness, filename) LEFT JOIN stat USING (harness, filename)"""


def resume_command() -> str:
    return f"""
WITH {ROWS},
named AS (
  SELECT event_id, harness, project, k, user_id, event_id % 4 AS kind,
    CASE event_id % 4 WHEN 0 THEN '/l/2024_' || user_id || '_id' || k || '.jsonl' WHEN 1 THEN '/l/rollout-2024-01-' || k || '-a-b-c-d-' || user_id || '.jsonl'
      WHEN 2 THEN '/l/session-' || k || '-' || user_id || '.json' ELSE 'ses' || k END AS filename,
    CASE WHEN k % 2 = 0 THEN '/w/' || project END AS cwd
  FROM log
),
ids AS (
  SELECT *, CASE kind
      WHEN 0 THEN CASE WHEN harness = 'pi' THEN 'id' || k ELSE '2024_' || user_id || '_id' || k END
      WHEN 1 THEN CASE WHEN harness = 'codex' THEN 'a-b-c-d-' || user_id ELSE 'rollout-2024-01-' || k || '-a-b-c-d-' || user_id END
      WHEN 2 THEN CASE WHEN harness = 'gemini' THEN '' ELSE 'session-' END || k || '-' || user_id
      ELSE 'ses' || k END AS session_id
  FROM named
)
SELECT event_id, harness, filename, session_id, {_resume('harness', 'session_id', 'cwd')} AS command, {LABEL} AS label FROM ids"""


def lexicon_merge(mode: str) -> str:
    default = (
        "SELECT 0 AS layer, p_partkey AS position, lower(p_name) AS word, CASE p_size % 3 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' ELSE 'strong' END "
        "AS severity, CASE WHEN p_size % 4 = 0 THEN lower(p_name) ELSE lower(p_brand) END AS \"group\" FROM part UNION ALL "
    )
    return f"""
SELECT word, severity, "group" FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY layer DESC, position DESC) AS place FROM (
    {default if mode == "extend" else ""}
    SELECT 1 AS layer, p_partkey AS position, lower(CASE WHEN p_size > 40 THEN p_type ELSE p_name END) AS word, 'moderate' AS severity, lower(p_type) AS "group"
    FROM part
  )
) WHERE place = 1"""


def document_terms() -> str:
    found = _found("found", "documents", "doc_id", [w for w, _, _ in LEXICON])
    return f"WITH {found}, {_lexicon(LEXICON)} SELECT f.doc_id, f.pass, f.start, f.word, l.group_name, l.severity FROM found f JOIN lexicon l ON l.word = f.word"


def document_phrases() -> str:
    words = [w.replace(".", "\\.") for w, _, _ in PHRASES] + ["term(?:0|[1-9][0-9]{0,4})"]
    entries = f"{_lexicon(PHRASES)}, entry AS (SELECT * FROM lexicon UNION ALL SELECT 'term' || i, 'mild', 'filler' FROM range({FILLERS}) r(i))"
    return f"WITH {_found('found', 'documents', 'doc_id', words)}, {entries} SELECT f.doc_id, f.pass, f.start, f.word, l.group_name, l.severity FROM found f JOIN entry l ON l.word = f.word"


def token_terms() -> str:
    """Words between non-word characters, looked up as written and else collapsed."""
    return f"""
WITH {_lexicon(LEXICON)},
tokens AS (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS start
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+') AS t FROM documents WHERE text <> '')
),
both_forms AS (
  SELECT *, array_to_string(list_filter(string_split(token, ''), lambda x, i: i = 1 OR x <> string_split(token, '')[i - 1]), '') AS short FROM tokens
)
SELECT doc_id, CASE WHEN token IN (SELECT word FROM lexicon) THEN 1 ELSE 2 END AS pass, CAST(start AS BIGINT) AS start, l.word, l.group_name, l.severity
FROM both_forms JOIN lexicon l ON l.word = CASE WHEN token IN (SELECT word FROM lexicon) THEN token ELSE short END"""


def built_in_terms() -> str:
    rows = built_in_rows()
    texts = "texts AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"
    return (
        f"WITH {texts}, {_found('found', 'texts', 'id', [w for w, _, _ in rows])}, {_lexicon(rows)} "
        "SELECT l.word, l.group_name, l.severity, count(*) AS hits FROM found f JOIN lexicon l ON l.word = f.word GROUP BY ALL"
    )


def session_terms() -> str:
    return f"""
WITH {ALL}
SELECT *, {_mood('feel_score')} AS feel_display FROM (
  SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total_hits, CAST(sum(({FEEL}) * count) OVER () AS BIGINT) AS feel_score FROM (
    SELECT group_name, min(severity) AS severity, count(*) AS count, count(*) FILTER (WHERE severity = 'strong') AS strong_count,
      count(*) FILTER (WHERE severity = 'moderate') AS moderate_count, count(*) FILTER (WHERE severity = 'mild') AS mild_count,
      string_agg(DISTINCT word, ', ' ORDER BY word) AS words
    FROM hit WHERE harness = 'pi' AND filename = 'c0' GROUP BY group_name
  )
) ORDER BY count DESC, group_name LIMIT 20"""


def usage_cost() -> str:
    plain = _cost("k * 100", "k * 10", "k * 50")
    return f"""
WITH {ROWS}, {PRICES}
SELECT event_id, round({plain}, 9) AS plain, round({_cost('k * 100', 'k * 10', 'k * 50', 'k * 5')}, 9) AS with_writes,
  round(CASE WHEN k % 10 = 0 OR coalesce(value, 0) = 0 THEN {plain} ELSE value END, 9) AS recorded_first
FROM log r LEFT JOIN price p ON p.model = r.model"""


def display_texts() -> str:
    price, quantity = "l_extendedprice", "CAST(l_quantity AS BIGINT)"
    seconds = f"{quantity} * l_linenumber * 97 - 97"
    texts = {
        "money4": _money(f"{price} / 7"),
        "money2": _money(f"{price} * l_discount", 2),
        "one_place": f"printf('%.1f', {price} / 8)",
        "tie": "printf('%.1f', l_quantity / 4)",
        "count_k": _human("big_k"),
        "count_b": _human("big_b"),
        "count_m": _human("big_b", "M"),
        "breakdown": _breakdown("q", "(q * 100)", "(q * 1000000)"),
        "duration": _duration("seconds"),
        "share": _percent("l_linenumber", "q"),
        "share_of_zero": "'0%'",
        "rate": f"CASE WHEN q = 0 THEN '0.00' ELSE printf('%.2f', {price} / q) END",
        "whole": "CAST(l_quantity / 2 AS BIGINT)",
        "mood": _mood("l_linenumber * 2 - 2"),
    }
    listed = ", ".join(f"{t} AS {n}" for n, t in texts.items())
    return f"""
SELECT l_orderkey, l_linenumber, l_quantity, {listed} FROM (
  SELECT *, {quantity} AS q, CAST(trunc({price}) AS BIGINT) * l_linenumber AS big_k, CAST(trunc({price}) AS BIGINT) * 100000 AS big_b,
    {seconds} AS seconds FROM lineitem
)"""


def sorted_providers() -> str:
    return f"""
WITH {LOGS}, spend AS (SELECT provider, sum(cost) AS spend FROM st GROUP BY provider)
SELECT 'asc' AS direction, provider, row_number() OVER (ORDER BY provider ASC NULLS LAST, spend DESC) AS place FROM spend
UNION ALL
SELECT 'desc', provider, row_number() OVER (ORDER BY provider DESC NULLS LAST, spend DESC) FROM spend"""


NONE = Where()

ORACLE: dict[str, str] = {
    "summary_kpis": _rounded(summary(NONE), LOGS, total_spend=4).replace("SELECT * REPLACE", "SELECT * EXCLUDE (per_turn) REPLACE", 1),
    "harness_rollup": _rounded(harnesses(NONE), LOGS, spend=4),
    "provider_rollup": _rounded(harnesses(NONE, "provider"), LOGS, spend=4),
    "model_rollup": _rounded(models(NONE), LOGS, spend=4, avg_cost_per_session=4),
    "project_rollup": _rounded(projects(NONE), LOGS, spend=4),
    "tool_rollup": _rounded(tools(NONE), LOGS),
    "model_tool_rollup": _rounded(tools(NONE, "model, provider, tool"), LOGS),
    "daily_timeline": _rounded(timeline(NONE), f"{ALL}, {day_sessions(NONE)}", cost=4),
    "session_list_top": session_list(),
    "session_terms": session_terms(),
    "term_groups": _rounded(term_groups(NONE), ALL),
    "term_models": _rounded(term_models(NONE), ALL),
    "term_harnesses": _rounded(term_harnesses(NONE), ALL),
    "term_model_harness": _rounded(term_pairs(NONE), f"{ALL}, {pair_hits(NONE)}"),
    "term_summary": _rounded(term_summary(NONE), f"{ALL}, {summary_inputs(NONE)}"),
    "session_model_stats": _rounded("SELECT * FROM st", LOGS, cost=4),
    "model_tools": f"WITH {LOGS} SELECT * FROM mt",
    "sessions": sessions(),
    "term_hits": f"WITH {ALL} SELECT * FROM hit",
    "tool_turn_asof": f"WITH {LOGS} SELECT * FROM used",
    "hit_turn_asof": f"""WITH {BOTH}
SELECT c.filename, c.ts, turn.model, turn.provider FROM ev_chats c
ASOF LEFT JOIN turn ON c.harness = turn.harness AND c.filename = turn.filename AND c.ts <= turn.ts WHERE c.is_user = 1""",
    "tool_error_or_join": tool_errors(),
    "pricing_flatten": f"WITH {PRICES} SELECT * FROM listed",
    "pricing_alias_overlay": f"WITH {PRICES} SELECT * FROM price",
    "usage_cost": usage_cost(),
    "normalize_pi": normalize_pi(),
    "normalize_opencode": normalize_opencode(),
    "normalize_claude": normalize_claude(),
    "normalize_codex": normalize_codex(),
    "normalize_gemini": normalize_gemini(),
    "messages_pi": messages_pi(),
    "messages_opencode": messages_opencode(),
    "messages_claude": messages_claude(),
    "messages_codex": messages_codex(),
    "messages_gemini": messages_gemini(),
    "detect_terms": document_terms(),
    "detect_terms_token": token_terms(),
    "detect_phrases": document_phrases(),
    "detect_term_counts": f"SELECT word, group_name, severity, count(*) AS hits, count(*) FILTER (WHERE pass = 2) AS collapsed_hits FROM ({document_terms()}) GROUP BY ALL",
    "detect_built_in": built_in_terms(),
    "lexicon_merge_extend": lexicon_merge("extend"),
    "lexicon_merge_replace": lexicon_merge("replace"),
    **{f"filters_{name}": stacked(Where(f)) for name, f in FILTERS.items()},
    "sort_nulls_last": sorted_providers(),
    "display_formats": display_texts(),
    "resume_command": resume_command(),
    "dates_and_texts": f"WITH {ROWS} SELECT event_id, ms, CAST(CAST(epoch_ms(ms) AS DATE) AS VARCHAR) AS day, strftime(epoch_ms(ms), '%Y-%m-%dT%H:%M:%S.%f') AS text FROM log",
}
ORACLE["unified_events"] = " UNION ALL BY NAME ".join(
    f"(SELECT * FROM ({ORACLE[f'normalize_{name}']}))" for name in ("pi", "opencode", "claude", "codex", "gemini")
)
ORACLE["hit_ids"] = f"SELECT count(*) AS hits, count(*) AS ids FROM ({ORACLE['term_hits']})"

SOURCES = ("pi", "opencode", "claude", "codex", "gemini")
RAW_LOGS = f"ev AS MATERIALIZED ({ORACLE['unified_events']}),{ROLLUPS}"
ORACLE["pipeline_sessions"] = sessions(RAW_LOGS, displayed=False, places=8)
ORACLE["pipeline_hits"] = f"""
WITH {RAW_LOGS},
said AS MATERIALIZED (
  SELECT *, row_number() OVER () AS message FROM ({" UNION ALL BY NAME ".join(f"(SELECT * FROM ({ORACLE[f'messages_{n}']}))" for n in SOURCES)})
),
{_found("found", "said", "message", [w for w, _, _ in TERMS])},
{_lexicon(TERMS)},
raw_hit AS (
  SELECT s.harness, s.filename, s.project, s.ts, f.word, l.group_name, l.severity
  FROM found f JOIN said s USING (message) JOIN lexicon l ON l.word = f.word
)
SELECT h.*, turn.model, turn.provider FROM raw_hit h
ASOF LEFT JOIN turn ON h.harness = turn.harness AND h.filename = turn.filename AND h.ts <= turn.ts"""
