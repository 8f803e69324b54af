"""The as-of lookup against a brute-force answer, with and without hot keys."""

import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionmill.operators.asof import asof
from sessionmill.operators.skew import join_facts

POINT = "k string, f string, at bigint, id bigint"
STATE = "k string, f string, at bigint, state struct<model: string, provider: string>"


def data(seed):
    rng = random.Random(seed)
    points, states = [], []
    for i in range(600):
        # A third of all points share one key, and many of them one instant.
        k = "hot" if rng.random() < 0.4 else rng.choice("abc")
        f = None if rng.random() < 0.03 else "f%d" % rng.randint(0, 1)
        at = 50 if rng.random() < 0.25 else rng.randint(0, 100)
        points.append((k, f, None if rng.random() < 0.05 else at, i))
    for _ in range(250):
        k = "hot" if rng.random() < 0.4 else rng.choice("abd")
        f = None if rng.random() < 0.03 else "f%d" % rng.randint(0, 1)
        at = None if rng.random() < 0.05 else rng.randint(10, 90)
        states.append((k, f, at, (rng.choice("xyz"), rng.choice(["p", "q", None]))))
    return points, states


def brute(points, states, forward):
    def rank(state):
        return tuple((v is not None, v or "") for v in state)

    out = {}
    for k, f, at, i in points:
        best = None
        for sk, sf, sat, state in states:
            if None in (k, f, at, sk, sf, sat) or (k, f) != (sk, sf) or (sat < at if forward else sat > at):
                continue
            key = (-sat if forward else sat, rank(state))
            if best is None or key > best[0]:
                best = (key, state)
        out[i] = best and best[1]
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize(
    "widths, by_instant", [((1,), False), ((7,), True), ((2, 10, 40), False), ((5, 20), True), ((1000,), False), ((1, 1000), True)]
)
def test_equals_brute_force(spark, widths, by_instant, forward):
    points, states = data(7 if forward else 11)
    found = asof(
        spark.createDataFrame(points, POINT), spark.createDataFrame(states, STATE), ["k", "f"], "at", "state",
        forward=forward, widths=widths, by_instant=by_instant,
    )
    rows = found.collect()
    assert len(rows) == len(points)
    got = {r.id: (tuple(r.state) if r.state else None) for r in rows}
    assert got == brute(points, states, forward)


def test_inner_drops_unmatched(spark):
    points = spark.createDataFrame([("a", "f", 1, 1), ("a", "f", 5, 2)], POINT)
    states = spark.createDataFrame([("a", "f", 3, ("m", None))], STATE)
    assert [r.id for r in asof(points, states, ["k", "f"], "at", "state", how="inner").collect()] == [2]


def test_one_key_with_most_rows(spark):
    """90 % of points and states in one key, half of the points at one instant."""
    points = spark.range(4000).selectExpr("if(id % 10 = 0, 'rare', 'hot') AS k", "'f' AS f", "if(id < 2000, 77, id) AS at", "id")
    states = spark.range(0, 4000, 5).selectExpr(
        "if(id % 50 = 0, 'rare', 'hot') AS k", "'f' AS f", "id AS at", "struct(string(id) AS model, 'p' AS provider) AS state"
    )
    rows = {
        by: asof(points, states, ["k", "f"], "at", "state", widths=(10, 100), by_instant=by).collect() for by in (False, True)
    }
    want = brute([tuple(r) for r in points.collect()], [(r.k, r.f, r.at, tuple(r.state)) for r in states.collect()], False)
    for found in rows.values():
        assert {r.id: (tuple(r.state) if r.state else None) for r in found} == want and len(found) == 4000


@pytest.mark.parametrize("forward", [False, True])
def test_one_hour_with_most_rows(spark, forward):
    """90 % of all rows in one hour of one key: every answer right, no task with over three times the median."""
    hour, total = 3_600_000, 40_000
    at = f"if(id % 10 = 0, {hour} * (id % 70), 5 * {hour} + (id * 7919) % {hour})"
    rows = spark.range(total).selectExpr("'hot' AS k", "'f' AS f", f"{at} AS at", "id")
    points = rows.where("id % 4 <> 1")
    states = rows.where("id % 4 = 1").selectExpr("k", "f", "at", "struct(string(id) AS model, 'p' AS provider) AS state")
    spread = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in spread}
    for name, value in spread.items():
        spark.conf.set(name, value)
    try:
        found = asof(points, states, ["k", "f"], "at", "state", forward=forward, how="inner")
        got = found.select("id", "state", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    tasks = sorted(Counter(r.task for r in got).values())
    assert len(tasks) == 8 and tasks[-1] <= 3 * tasks[4]
    line = {}
    for r in states.collect():
        line[r.at] = max(line.get(r.at, ""), r.state.model)
    times = sorted(line)
    want = {}
    for r in points.collect():
        i = bisect.bisect_left(times, r.at) if forward else bisect.bisect_right(times, r.at) - 1
        if 0 <= i < len(times):
            want[r.id] = line[times[i]]
    assert {r.id: r.state.model for r in got} == want and len(got) == len(want)


def test_widths_must_nest(spark):
    points = spark.createDataFrame([("a", "f", 1, 1)], POINT)
    states = spark.createDataFrame([("a", "f", 3, ("m", None))], STATE)
    with pytest.raises(ValueError):
        asof(points, states, ["k", "f"], "at", "state", widths=(7, 10))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("salts", [1, 8])
def test_join_facts_equals_plain_join(spark, salts, how):
    rows = spark.range(1000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 40) END AS k", "id"
    )
    facts = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), (None, 4), ("unused", 5)], "k string, fact int")
    got = join_facts(rows, facts, ["k"], how, salts)
    want = rows.join(facts, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
