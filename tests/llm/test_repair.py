import random

import pytest
from brute_repair import repairs
from pyspark.sql import functions as F

from sessionmill.llm import repair
from sessionmill.llm.frames import read

SF = "/root/testdata/sf0.001"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, key string, index long, audit string"


def found(frame, **more):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repaired(frame, **more).collect()}


def odd_rows(seed=3, conversations=60):
    """Every role, nulls anywhere, ties, repeated rows, blank, cut off and very long texts, and one conversation with a third of all rows."""
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t\n\x0b\f\r", "Done.  \n", "x" * 50_000 + ".", "äö ", "漢字。", None, "a\nb:c.", "..."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", "ursula", None]
    for conv in [*range(conversations), None]:
        n = rng.choice([1, 2, 3, 5, 8, 13])
        for turn in range(n):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(1000, t, rng.choice(roles), rng.choice(texts[:7])) for t in range(len(rows) // 2)]
    rows += rng.choices(rows, k=20)
    return rows


@pytest.mark.parametrize(("block", "fan"), [(repair.BLOCK, repair.FAN), (4, 3), (1, 2)])
def test_repairs_equal_brute_force(spark, block, fan):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "k", 1, "a") for r in rows], SCHEMA).repartition(3)
    assert found(frame, block=block, fan=fan) == repairs(rows)


def test_repairs_of_the_given_conversations(spark):
    frame = read(spark, SF, "conversations")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert found(frame) == repairs(rows)


def test_solutions_of_every_short_conversation():
    """The division against all edit sequences, by way of the recursion of brute_repair, for every string of up to four turns."""
    from itertools import product

    from brute_repair import cheapest

    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    for n in range(1, 5):
        for codes in product("dsuaxUA", repeat=n):
            rows = [(i, roles[c.lower()], "") for i, c in enumerate(codes)]
            faults = ["blank" if c == "d" else "truncated" if c.isupper() else None for c in codes]
            audit, cost, state = repair.solve("".join(codes), 0, list(repair.END))
            more = repair.finish(state)
            assert (cost + repair.INSERT * len(more), audit + more) == cheapest(rows, faults), codes


def test_blocks_of_a_long_conversation_meet():
    rng = random.Random(5)
    codes = "".join(rng.choices("dsuaxSUAX", k=3000))
    whole = repair.solve(codes, 0, list(repair.END))
    parts = [codes[i : i + 7] for i in range(0, len(codes), 7)]
    ends = repair._ends([repair.matrix(p) for p in parts], list(repair.END))
    maps = [repair.crossings(p, 0, len(p), e) for p, e in zip(parts, ends, strict=True)]
    entries = repair._entries(maps, [0])
    solved = [repair.solve(p, s[0], e) for p, s, e in zip(parts, entries, ends, strict=True)]
    assert ("".join(s[0] for s in solved), sum(s[1] for s in solved), solved[-1][2]) == whole


def test_nothing_left_and_nothing_there(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi.", "k", 1, "a")], SCHEMA)
    gone = repair.repaired(frame, damage=lambda c: repair.damaged(c).where(F.lit(False))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
    assert repair.repaired(frame.limit(0)).collect() == []
