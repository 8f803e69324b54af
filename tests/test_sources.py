"""Normalisers on hand-made log files, with results derived by hand."""

import pytest
from fixture_logs import MS, write_home

from sessionmill.operators import detect, lexicon
from sessionmill.operators import pricing as P
from sessionmill.schemas import EVENT, MESSAGE
from sessionmill.sources import readers, registry


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("home with space+plus"))
    write_home(spark, folder)
    return folder


@pytest.fixture(scope="module")
def prices(spark, home):
    return registry.Prices.of(readers.read_catalogue(spark, f"{home}/prices.json"), P.alias_frame(spark))


@pytest.fixture(scope="module")
def events(spark, home, prices):
    """Events by source, in time order."""
    raw = registry.discover(spark, home)
    assert set(raw) == set(registry.SOURCES)
    frame = registry.unified_events(registry.parse_all(raw), prices)
    assert frame.schema.simpleString() == EVENT.simpleString()
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.harness, r.ts or 0, r.tool or "", r.is_turn)):
        found.setdefault(r.harness, []).append(r)
    return found


def brief(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_pi(events, home):
    rows = events["pi"]
    path = f"{home}/.pi/agent/sessions/--home-u-shop--/2025_p1.jsonl"
    assert {r.filename for r in rows} == {path}
    # A broken line and a line of another type without a message are no events.
    assert len(rows) == 7
    assert {r.project for r in rows} == {"shop"}
    untimed, session, asked, answered, tool, no_tool, aliased = rows
    assert (untimed.ts, untimed.is_user, session.is_user, session.session_cwd) == (None, 1, 0, "/home/u/shop")
    assert (asked.ts, asked.is_user, asked.provider, asked.model) == (MS(1), 1, "unknown", None)
    # The highest listed price counts: input 3 (azure), output 8, cache read 0.5.
    assert answered.cost == pytest.approx((1000 * 3 + 100 * 8 + 10 * 0.5) / 1e6)
    assert (answered.in_tok, answered.out_tok, answered.cache_tok, answered.is_turn) == (1000, 100, 10, 1)
    assert (tool.is_tool, tool.is_error, tool.tool) == (1, 1, "bash")
    assert (no_tool.is_tool, no_tool.is_error) == (0, 0)
    assert (aliased.cost, aliased.in_tok, aliased.provider) == (0.25, 13, "unknown")


def test_claude(events):
    rows = events["claude"]
    assert {(r.project, r.session_cwd, r.provider) for r in rows} == {("app", "/w/app", "anthropic")}
    turns = [r for r in rows if r.is_turn]
    first, second = turns
    assert (first.in_tok, first.out_tok, first.cache_tok) == (10 + 4 + 3 + 1, 20, 30)
    assert first.cost == pytest.approx((10 * 3 + 8 * 3.75 + 20 * 15 + 30 * 0.3) / 1e6)
    assert (second.cost, second.in_tok) == (1.5, 7)
    # Meta records, records without content and tool results are not what the user said;
    # a null content is.
    assert [r.ts for r in rows if r.is_user] == [MS(0), MS(5), MS(8)]
    assert brief([r for r in rows if r.is_tool], "ts", "tool", "is_error") == [
        (MS(1), "Bash", 1), (MS(1), "Read", 0), (MS(1), "server_tool_use", 0), (MS(4), "Edit", 1),
    ]


def test_codex(events):
    rows = events["codex"]
    assert {(r.project, r.model, r.provider) for r in rows} == {("lib", "gpt-x", "openai")}
    assert brief(rows, "ts", "is_turn", "is_user") == [
        (MS(0), 0, 0), (MS(1), 0, 1), (MS(2), 0, 1), (MS(3), 1, 0), (MS(4), 0, 0),
    ]
    usage = rows[-1]
    # More cached than fresh input tokens count as none.
    assert (usage.in_tok, usage.out_tok, usage.cache_tok) == (0, 10, 140)
    assert usage.cost == pytest.approx((10 * 8 + 140 * 0.5) / 1e6)


def test_gemini(events):
    rows = events["gemini"]
    assert {r.project for r in rows} == {"hash1"}
    assert brief(rows, "ts", "model", "provider", "is_turn", "is_user", "is_tool", "is_error", "tool", "cost", "cache_tok") == [
        (MS(1), None, "google", 0, 1, 0, 0, None, 0.0, 0),
        (MS(2), "free", "zeta", 1, 0, 0, 0, None, 0.0, 7),
        (MS(3), "free", "zeta", 0, 0, 1, 1, "ls", 0.0, 0),
    ]


def test_opencode(events):
    rows = events["opencode"]
    # The user message of a session without a session row is dropped, its assistant message is not.
    assert brief(rows, "filename", "ts", "project", "model", "provider", "is_turn", "is_user", "is_tool", "is_error") == [
        ("s1", MS(0), "dir", None, None, 0, 1, 0, 0),
        ("s1", MS(1), "own", "sonnet", "anthropic", 1, 0, 0, 0),
        ("s2", MS(2), "opencode", "unknown-model", "opencode", 1, 0, 0, 0),
        ("s1", MS(2), "own", "sonnet", "anthropic", 0, 0, 1, 1),
    ]
    priced, recorded = rows[1], rows[2]
    assert (priced.in_tok, priced.out_tok, priced.cache_tok) == (102, 10, 5)
    assert priced.cost == pytest.approx((100 * 3 + 2 * 3.75 + 10 * 15 + 5 * 0.3) / 1e6)
    assert recorded.cost == 0.5


def test_messages(spark, home):
    frame = registry.user_messages(registry.discover(spark, home))
    assert frame.schema.simpleString() == MESSAGE.simpleString()
    got = sorted((r.harness, r.ts or 0, r.project, r.text) for r in frame.collect())
    assert got == sorted([
        ("pi", MS(1), "home-u-shop", "what the hell, helllo shit"),
        ("pi", 0, "home-u-shop", '[{"type":"text","text":"damn"}]'),
        ("claude", MS(0), "app", "[not a list]"),
        ("claude", MS(5), "app", "null"),
        ("claude", MS(8), "app", "wtf"),
        ("codex", MS(2), "lib", "crap"),
        ("gemini", MS(1), "hash1", "stfu"),
        ("opencode", MS(0), "dir", "fuuuck"),
    ])


def test_hits_equal_detection_on_messages(spark, home):
    """Detecting before the joins gives what detecting on complete messages gives."""
    raw = registry.discover(spark, home)
    words = lexicon.built_in_rows()
    early = registry.term_hits(raw, words)
    late = detect.as_hits(detect.detect(registry.user_messages(raw), words))
    got = sorted(map(tuple, early.drop("hit_id").collect()))
    assert got == sorted(map(tuple, late.drop("hit_id").collect())) and got
    assert len({r.hit_id for r in early.collect()}) == len(got)
    # 'shit' is found twice behind a collapsed run: once as written, once at its shorter offset.
    words_of = sorted((r.harness, r.word, r.ts) for r in early.collect())
    assert words_of == sorted([
        ("pi", "hell", MS(1)), ("pi", "shit", MS(1)), ("pi", "shit", MS(1)), ("pi", "damn", 0),
        ("claude", "wtf", MS(8)), ("codex", "crap", MS(2)), ("gemini", "stfu", MS(1)), ("opencode", "fuck", MS(0)),
    ])


def test_absent_sources_are_skipped(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        registry.discover(spark, str(tmp_path / "nothing"))
    write_home(spark, str(tmp_path / "some"), opencode=False)
    assert "opencode" not in registry.discover(spark, str(tmp_path / "some"))


def test_equal_hits_have_ids_of_their_own(spark):
    rows = [("pi", "f", "p", None, "hell hell")] * 3 + [("pi", "f", "p", 5, "hell")]
    found = detect.detect(spark.createDataFrame(rows, "harness string, filename string, project string, ts long, text string"), lexicon.built_in_rows())
    hits = detect.as_hits(found).collect()
    assert len(hits) == 7 and len({h.hit_id for h in hits}) == 7


def test_half_an_export_is_an_error(spark, home, tmp_path):
    import shutil

    shutil.copytree(f"{home}/opencode", tmp_path / "opencode")
    shutil.move(tmp_path / "opencode" / "part", tmp_path / "part")
    with pytest.raises(FileNotFoundError, match="not all"):
        registry.discover(spark, str(tmp_path))


def test_lenient_numbers_and_times(spark):
    from sessionmill.functions import values as V
    from pyspark.sql import functions as F

    counts = {"2.5": 3, "12.5": 13, "0.5": 1, "-2.5": -3, "1e3": 1000, "12.7": 13, "x": None, "7": 7}
    got = spark.createDataFrame([(t,) for t in counts], "t string").select("t", V.to_long(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == counts
    times = {"2025": None, "2025-03": None, "2025-03-04": 1741046400000, "2025-03-04T00:00:01Z": 1741046401000, "": None}
    got = spark.createDataFrame([(t,) for t in times], "t string").select("t", V.iso_millis(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == times


def test_token_mode_finds_every_entry(spark):
    texts = spark.createDataFrame([("The  end of c++ and the end é.",)], "text string")
    words = [("the end", "mild", "g"), ("c++", "mild", "g"), ("of", "mild", "g"), ("é", "mild", "g"), ("end", "mild", "g")]
    found = sorted((r.start, r["pass"], r.word) for r in detect.detect(texts, words, mode="token").collect())
    assert found == [(1, 1, "end"), (2, 1, "of"), (3, 1, "c++"), (5, 1, "the end"), (7, 1, "é")]
    assert {r.word for r in detect.detect(texts, words).collect()} == {"end", "of", "the end"}


def test_opencode_from_json_export(spark, home, tmp_path):
    raw = readers.read_opencode(spark, f"{home}/opencode")
    for name, frame in raw.items():
        frame.write.json(str(tmp_path / name))
    again = readers.read_opencode(spark, str(tmp_path), "json")
    for name, frame in raw.items():
        assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, again[name].collect()))


def test_catalogue(spark, prices):
    rows = {r.model: r for r in prices.overlaid.collect()}
    assert set(rows) == {
        "gpt-x", "sonnet", "kimi-k2.6", "free",
        "accounts/fireworks/routers/kimi-k2p6-turbo", "accounts/fireworks/models/kimi-k2p6",
    }
    x = rows["gpt-x"]
    assert (x.provider, x.friendly_name, x.input_cost, x.cache_write_cost) == ("openai", "X on A", 3.0, None)
    assert rows["accounts/fireworks/models/kimi-k2p6"].output_cost == 4.0
