"""The batch refresh and the incremental ingest, end to end on fixture logs."""

import datetime as dt
import glob
import json
import os
import shutil

import pytest
from fixture_logs import MS, write_home

from sessionmill.operators import lexicon
from sessionmill.operators import pricing as P
from sessionmill.plans import layout, overview, refresh, terms
from sessionmill.plans.bundles import VIEWS, answer, bundle
from sessionmill.plans.filters import Filters
from sessionmill.plans.store import TABLES, Rollups
from sessionmill.sources import readers, registry
from sessionmill.streaming import compact, ingest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("home"))
    out = str(tmp_path_factory.mktemp("out"))
    catalogue = write_home(spark, home)
    return home, out, catalogue, refresh.refresh(spark, home, out, catalogue)


def test_refresh_publishes_a_run(spark, made):
    home, out, catalogue, run = made
    assert refresh.latest_run(spark, out) == run
    r = refresh.load_latest(spark, out)
    assert {s.harness for s in r.sessions.collect()} == set(registry.SOURCES)
    # A run that was written but not published is not seen.
    shutil.copytree(run, f"{out}/run=99999999T000000000000")
    assert refresh.latest_run(spark, out) == run


def test_invariants(spark, made):
    r = Rollups.load(spark, made[3])
    total = r.events.where("model <> ''").selectExpr("round(sum(cost), 9)").first()[0]
    assert r.stats.selectExpr("round(sum(cost), 9)").first()[0] == total > 0
    used = r.model_tools.selectExpr("sum(count)").first()[0]
    assert used <= r.events.where("is_tool = 1").count()
    raw = spark.read.parquet(f"{made[3]}/hits_raw")
    assert raw.count() == r.hits.count() == 8
    sessions = {s.harness: s for s in r.sessions.collect()}
    pi = sessions["pi"]
    assert (pi.start_time, pi.end_time, pi.duration_sec) == (MS(0), MS(5), 5.0)
    assert (pi.user_turns, pi.agent_turns, pi.tool_count, pi.errors) == (2, 2, 1, 1)
    assert pi.tool_breakdown == {"bash": 1} and [t.tool for t in pi.model_tool_breakdown] == ["bash"]


def test_hits_go_to_the_next_turn(spark, made):
    hits = {(h.harness, h.word, h.ts): h.model for h in Rollups.load(spark, made[3]).hits.collect()}
    assert hits[("pi", "hell", MS(1))] == "gpt-x"
    # A message without a time counts as time 0 and so goes to the first turn.
    assert hits[("pi", "damn", 0)] == "gpt-x"
    # A message after the last turn stays unattributed.
    assert hits[("claude", "wtf", MS(8))] is None
    assert hits[("codex", "crap", MS(2))] == "gpt-x"


def test_no_text_is_written(made):
    """No column of any table holds a message."""
    for path in glob.glob(f"{made[3]}/**/*.parquet", recursive=True):
        with open(path, "rb") as f:
            content = f.read()
        for text in (b"what the", b"[not a list]", b"<environment_context>", b"fuuuck"):
            assert text not in content


def test_views(spark, made):
    r = Rollups.load(spark, made[3])
    for view in VIEWS:
        answers = answer(bundle(view, r))
        assert set(answers) == set(VIEWS[view])
        assert answers.get("session_count", [[6]])[0][0] == 6
    pi = next(s for s in r.sessions.collect() if s.harness == "pi")
    page = answer(bundle("session", r, Filters(harness="pi", filename=pi.filename)))
    assert {g.group_name for g in page["session_profanity"]} == {"hell", "shit", "damn"}
    assert page["session_profanity"][0].total_hits == 4
    with pytest.raises(ValueError):
        bundle("nothing", r)


QUESTIONS = {
    "sessions": lambda r: overview.session_list(r, Filters(provider="fireworks", model="gpt-x")),
    "summary": lambda r: overview.summary(r, Filters(provider="fireworks", tool="bash")),
    "models": lambda r: overview.models(r, Filters(project="proj")),
    "tools": lambda r: overview.tools(r, Filters(project="proj")),
}


@pytest.mark.parametrize("name", QUESTIONS)
def test_stored_questions_do_not_shuffle_sessions(spark, made, name):
    """Rollups meet bucket by bucket; plain files of the same rows are shuffled by session and give the same answer."""
    assert layout.recorded(spark, made[3]) == layout.FEWEST
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = QUESTIONS[name](Rollups.load(spark, made[3]))
        plain = QUESTIONS[name](Rollups(**{t: spark.read.parquet(f"{made[3]}/{t}") for t in TABLES}))
        plans = [q._jdf.queryExecution().executedPlan().toString() for q in (stored, plain)]
        answers = [q.collect() for q in (stored, plain)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert answers[0] == answers[1]
    by_session = [plan.count("Exchange hashpartitioning(harness") for plan in plans]
    assert by_session[0] == 0 < by_session[1], plans[0]


def test_bucket_count_grows_with_the_events(spark, made, monkeypatch):
    events = spark.read.parquet(f"{made[3]}/events")
    assert layout.buckets_for(events) == layout.FEWEST
    monkeypatch.setattr(layout, "BUCKET_BYTES", 100)
    many = layout.buckets_for(events)
    assert many > layout.FEWEST and many & (many - 1) == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mill_")]


def test_session_list_json(spark, made):
    r = Rollups.load(spark, made[3])
    rows = {s.harness: s for s in overview.session_list(r).collect()}
    assert json.loads(rows["claude"].tool_breakdown_json) == {"Bash": 1, "Edit": 1, "Read": 1, "server_tool_use": 1}
    assert json.loads(rows["pi"].models_json) == ["accounts/fireworks/models/kimi-k2p6", "gpt-x"]
    stats = {m["model"]: m for m in json.loads(rows["pi"].model_stats_json)}
    assert stats["gpt-x"]["tools"] == 1 and stats["gpt-x"]["token_breakdown_display"] == "1.0K in / 100 out / 10 cache"
    assert rows["pi"].resume_command == 'pi --session "p1"'
    assert rows["codex"].resume_command == 'codex resume "a-b-c-d-e"'
    assert rows["gemini"].resume_command == 'gemini --resume "g1"'
    assert rows["opencode"].resume_command.startswith('opencode "/k/')


def test_collection_switched_off(spark, made, tmp_path):
    home, _, catalogue, _ = made
    run = refresh.refresh(spark, home, str(tmp_path), catalogue, collect_terms=False)
    r = Rollups.load(spark, run)
    assert r.hits.count() == 0
    assert terms.term_summary(r).first().total_swears == 0


def test_refresh_again_gives_the_same_tables(spark, made, tmp_path):
    home, _, catalogue, run = made
    again = refresh.refresh(spark, home, str(tmp_path), catalogue)
    for table in TABLES:
        left, right = (spark.read.parquet(f"{x}/{table}").collect() for x in (run, again))
        assert sorted(map(repr, left)) == sorted(map(repr, right)), table


def _prices(spark, catalogue):
    return registry.Prices.of(readers.read_catalogue(spark, catalogue), P.alias_frame(spark))


def _same(left: Rollups, right: Rollups, harnesses):
    for table in TABLES:
        a, b = (
            sorted(repr(r.asDict()) for r in getattr(x, table).collect() if r.harness in harnesses)
            for x in (left, right)
        )
        assert a == b, table


def test_stream_equals_batch(spark, made, tmp_path):
    home, _, catalogue, run = made
    prices, words = _prices(spark, catalogue), lexicon.entries(lexicon.build(spark))
    out = str(tmp_path / "live")
    for source in ingest.LANDINGS:
        query = ingest.stream_source(spark, source, home, out, f"{tmp_path}/checkpoint/{source}", prices, words)
        query.awaitTermination(300)
        assert query.exception() is None
    _same(ingest.load(spark, out), Rollups.load(spark, run), set(ingest.LANDINGS))


def test_changed_file_replaces_its_session(spark, made, tmp_path):
    home = str(tmp_path / "home")
    shutil.copytree(made[0], home)
    prices, words = _prices(spark, made[2]), lexicon.entries(lexicon.build(spark))
    out = str(tmp_path / "live")
    long_ago = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    assert ingest.store_changed(spark, "pi", home, out, long_ago, prices, words)
    path = glob.glob(f"{home}/.pi/agent/sessions/*/*.jsonl")[0]
    with open(path, "a") as log:
        log.write(json.dumps({"type": "message", "timestamp": "2025-03-04T10:00:09.500Z",
                              "message": {"role": "toolResult", "toolName": "bash"}}) + "\n")
    past = dt.datetime.now(dt.timezone(dt.timedelta(hours=2))) - dt.timedelta(hours=1)
    assert ingest.store_changed(spark, "pi", home, out, past, prices, words)
    r = ingest.load(spark, out)
    (session,) = r.sessions.collect()
    assert (session.tool_count, session.end_time) == (2, MS(9))
    assert r.events.count() == 8
    # Running the same change again replaces its own result.
    assert ingest.store_changed(spark, "pi", home, out, past, prices, words)
    assert ingest.load(spark, out).events.count() == 8
    # A wider read is newer, not older.
    assert ingest.store_changed(spark, "pi", home, out, long_ago, prices, words)
    assert ingest.load(spark, out).events.count() == 8
    # Nothing changed since tomorrow; a time without a zone is no time.
    assert not ingest.store_changed(spark, "pi", home, out, dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1), prices)
    with pytest.raises(ValueError):
        ingest.store_changed(spark, "pi", home, out, dt.datetime(2020, 1, 1), prices)
    assert os.path.exists(path)


def test_streams_do_not_overwrite_each_other(spark, made, tmp_path):
    """Two checkpoints on one folder, a changed file between them, and the relational source."""
    prices, out = _prices(spark, made[2]), str(tmp_path / "live")
    homes = []
    for i in (1, 2):
        homes.append(str(tmp_path / f"home{i}"))
        shutil.copytree(made[0], homes[-1])
    for i, home in enumerate(homes):
        ingest.stream_source(spark, "pi", home, out, f"{tmp_path}/checkpoint{i}", prices).awaitTermination(300)
        long_ago = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
        assert ingest.store_changed(spark, "opencode", home, out, long_ago, prices)
    r = ingest.load(spark, out)
    names = {s.filename for s in r.sessions.collect() if s.harness == "pi"}
    assert len(names) == 2 and all(any(n.startswith(h) for n in names) for h in homes)
    batch = Rollups.load(spark, made[3])
    assert r.events.where("harness = 'opencode'").count() == batch.events.where("harness = 'opencode'").count() > 0
    assert not ingest.store_changed(spark, "opencode", homes[0], out, dt.datetime.now(dt.timezone.utc), prices)


def test_compaction_keeps_what_holds(spark, made, tmp_path):
    home, out = str(tmp_path / "home"), str(tmp_path / "live")
    shutil.copytree(made[0], home)
    prices = _prices(spark, made[2])
    long_ago, now = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(0)

    def folders():
        return len(glob.glob(f"{out}/*/source=*/version=*"))

    def same(left, right):
        for table in TABLES:
            a, b = (sorted(repr(r.asDict()) for r in getattr(x, table).collect()) for x in (left, right))
            assert a == b, table

    for source in ("pi", "codex", "pi"):
        assert ingest.store_changed(spark, source, home, out, long_ago, prices)
    before = ingest.load(spark, out)
    rows = before.events.count()
    assert rows > 0 and compact.vacuum(spark, out, now) == 0
    compact.compact(spark, out)
    # A reader that began before the compaction, one after it, and one after old folders went.
    assert before.events.count() == rows and compact.vacuum(spark, out, dt.timedelta(hours=1)) == 0
    same(ingest.load(spark, out), before)
    kept, many = {t: getattr(before, t).collect() for t in TABLES}, folders()
    assert compact.vacuum(spark, out, now) > 0 and folders() == 0 < many
    after = ingest.load(spark, out)
    for table in TABLES:
        assert sorted(map(repr, kept[table])) == sorted(repr(r) for r in getattr(after, table).select(*kept_columns(before, table)).collect())
    # A newer batch wins over the generation, and is compacted with it.
    path = glob.glob(f"{home}/.pi/agent/sessions/*/*.jsonl")[0]
    with open(path, "a") as log:
        log.write(json.dumps({"type": "message", "timestamp": "2025-03-04T10:00:09.500Z",
                              "message": {"role": "toolResult", "toolName": "bash"}}) + "\n")
    assert ingest.store_changed(spark, "pi", home, out, long_ago, prices)
    grown = ingest.load(spark, out)
    assert grown.events.count() == rows + 1
    compact.compact(spark, out)
    same(ingest.load(spark, out), grown)
    compact.vacuum(spark, out, now)
    assert ingest.load(spark, out).events.count() == rows + 1 and len(os.listdir(f"{out}/{compact.COMPACTED}")) == 1


def kept_columns(rollups, table):
    return getattr(rollups, table).columns
