"""Filters, sort orders, display texts and other expressions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionmill.functions import display as D
from sessionmill.functions import values as V
from sessionmill.operators import resume, rollups
from sessionmill.plans.filters import Filters
from sessionmill.schemas import EVENT


def test_filters_from_strings():
    f = Filters.from_strings({"days": "7", "harness": "pi", "sort_dir": "asc", "tool": "bash"})
    assert (f.days, f.harness, f.tool, f.project, f.sort_dir) == (7, "pi", "bash", "", "asc")
    for text in ("", "all", "x", "1.5", " 7", "9999999999", "1_0"):
        assert Filters.from_strings({"days": text}).days == 0
    assert Filters.from_strings({"days": "+3"}).days == 3
    assert Filters.from_strings({"sort_dir": "ASC"}).sort_dir == "desc"


def test_look_back(spark):
    day = 86_400_000
    first = (dt.date(2025, 3, 1) - dt.date(1970, 1, 1)).days * day
    frame = spark.createDataFrame([(first - 1,), (first,), (first + 5 * day,)], "start_time bigint")
    assert Filters(days=4, as_of=dt.date(2025, 3, 5)).recent(frame).count() == 2
    assert Filters().recent(frame).count() == 3


@pytest.mark.parametrize("direction,want", [("asc", ["a", "b", None]), ("desc", ["b", "a", None])])
def test_nulls_are_last(spark, direction, want):
    frame = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "k string, spend int")
    f = Filters(sort_table="t", sort_by="k", sort_dir=direction)
    assert [r.k for r in frame.orderBy(*f.order("t", {"k": "k"}, "spend")).collect()] == want
    # Unknown tables and columns fall back to the default column, descending.
    for other in (f.but(sort_table="u"), f.but(sort_by="z")):
        assert [r.spend for r in frame.orderBy(*other.order("t", {"k": "k"}, "spend")).collect()] == [3, 2, 1]


def test_fixed_is_printf(spark):
    rng = random.Random(3)
    values = [0.0, 0.15, 0.25, 0.35, 2.5, 12.25, 5e-5, 1.5e-4, 2.5e-4, 1e-30, 99.95, 0.99995, 1e15 + 0.5, -0.15, -3.25, -1e-9]
    values += [rng.random() * 10 ** rng.randint(-6, 9) for _ in range(3000)]
    values += [rng.randint(0, 10**7) / 1000 for _ in range(3000)] + [rng.randint(0, 10**6) / 32 for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in [None, *values]], "x double")
    for places in (1, 2, 4):
        for r in frame.selectExpr("x", f"{D.fixed('x', places)} AS t").collect():
            assert r.t == (None if r.x is None else f"{r.x:.{places}f}"), r.x


def test_display_texts(spark):
    def one(text):
        return spark.range(1).selectExpr(f"{text} AS t").first().t

    assert [one(D.human_count(f"{n}L")) for n in (0, 999, 1000, 999_950, 1_000_000, 12_345_678_901)] == [
        "0", "999", "1.0K", "1000.0K", "1.0M", "12.3B"]
    assert one(D.human_count("12345678901L", "M")) == "12345.7M"
    assert [one(D.human_duration(f"{n}L")) for n in (-1, 0, 59, 60, 3599, 3600, 90_000)] == [
        "-", "-", "59s", "1m 0s", "59m 59s", "1h 0m", "25h 0m"]
    assert (one(D.percent("1", "0")), one(D.percent("1", "3"))) == ("0%", "33.3%")
    assert (one(D.money_ratio("1D", "0")), one(D.money_ratio("1D", "8", 2))) == ("$0.0000", "$0.12")
    assert [one(D.round_even(x)) for x in ("2.5D", "3.5D", "-2.5D")] == [2, 4, -2]
    assert [one(D.mood(str(n))) for n in (0, 3, 9, 10)] == ["calm", "irked", "frustrated", "furious"]


def test_values(spark):
    def one(column):
        return spark.range(1).select(column.alias("t")).first().t

    lit = F.lit
    assert [one(V.to_long(lit(t))) for t in ("12", "12.7", "1e3", "x", "1e30")] == [12, 13, 1000, None, None]
    assert [one(V.iso_millis(lit(t))) for t in ("2025-03-04T10:00:00Z", "2025-03-04T10:00:00+02:00", "soon")] == [
        1741082400000, 1741082400000, None]
    assert one(V.iso_millis(lit("1969-12-31T23:59:59.9996Z"))) == 0
    assert [one(V.part_from_end(lit(p), 2)) for p in ("a/b/c", "c", "/c")] == ["b", None, ""]
    ms = lit(1704067200123).cast("bigint")
    assert one(V.zone_text(ms, "Europe/Paris")) == "2024-01-01T01:00:00.123000"
    assert str(one(V.zone_date(ms, "America/New_York"))) == "2023-12-31"
    assert str(one(V.utc_date(lit(-1).cast("bigint")))) == "1969-12-31"


@pytest.mark.parametrize("harness,name,want", [
    ("pi", "/l/2025_abc.jsonl", "abc"), ("pi", "/l/plain.jsonl", "plain"), ("pi", "/l/ends_.jsonl", "ends_"),
    ("codex", "/l/rollout-1-2-a-b-c-d-e.jsonl", "a-b-c-d-e"), ("codex", "/l/a-b.jsonl", "a-b"),
    ("gemini", "/l/session-x-1.json", "x-1"), ("claude", "/l/session-x.y.jsonl", "session-x.y"), ("opencode", "ses_1", "ses_1"),
])
def test_session_id(spark, harness, name, want):
    row = spark.range(1).select(resume.session_id(F.lit(harness), F.lit(name)).alias("t")).first()
    assert row.t == want


def test_resume_command_quotes(spark):
    row = spark.range(1).select(
        resume.resume_command(F.lit("opencode"), F.lit("s1"), F.lit('/a "b"')).alias("t"),
        resume.resume_command(F.lit("other"), F.lit("s1"), F.lit(None)).alias("u"),
    ).first()
    assert (row.t, row.u) == ('opencode "/a \\"b\\"" --session "s1"', "")


def event(ts, **changes):
    base = dict.fromkeys(EVENT.fieldNames())
    base.update(harness="pi", filename="f", cost=0.0, in_tok=0, out_tok=0, cache_tok=0, is_turn=0, is_user=0, is_tool=0, is_error=0)
    base.update(ts=ts, **changes)
    return tuple(base[n] for n in EVENT.fieldNames())


def test_tools_belong_to_the_turn_in_force(spark):
    events = spark.createDataFrame([
        event(1, is_tool=1, tool="early"),
        event(2, is_turn=1, model="a", provider=None),
        event(3, is_tool=1, tool="t", is_error=1),
        event(4, is_turn=1, model="b", provider="p"),
        event(4, is_turn=1, model="c", provider="p"),
        event(4, is_tool=1, tool="t"),
        event(9, is_tool=1, tool="t"),
        event(None, is_tool=1, tool="t"),
        event(5, is_turn=1, model="", provider="p"),
        event(6, model="a", provider=None, cost=2.0, in_tok=5),
    ], EVENT)
    tools = rollups.model_tools(events)
    assert sorted((r.model, r.provider, r["count"], r.errors) for r in tools.collect()) == [("a", None, 1, 1), ("c", "p", 2, 0)]
    stats = {r.model: r for r in rollups.session_model_stats(events, tools).collect()}
    assert set(stats) == {"a", "b", "c"}
    assert (stats["a"].turns, stats["a"].cost, stats["a"].in_tok, stats["a"].tools, stats["a"].errors) == (1, 2.0, 5, 1, 1)
    assert (stats["b"].turns, stats["b"].tools, stats["c"].tools) == (1, 0, 2)
    (session,) = rollups.sessions(events, tools, rollups.session_model_stats(events, tools)).collect()
    # The session counts every row with a tool name, attributed or not.
    assert (session.tool_count, session.start_time, session.end_time, session.duration_sec) == (5, 1, 9, 0.008)
    assert session.models == ["", "a", "b", "c"]


def test_session_without_valid_time_is_dropped(spark):
    events = spark.createDataFrame([event(None, is_user=1), event(0, is_user=1), event(-5, is_user=1)], EVENT)
    assert rollups.session_facts(events).count() == 0
