"""Repair of conversations by an edit path of least cost, in linear space.

The turns of a conversation are to read `(s?(ua)+)?` by the initials of their roles, which four states follow: nothing yet, after system, after
user, after assistant. Keeping, rerolling, deleting or inserting a turn each has a cost and one next state. Hirschberg's
division finds the path without a table of all turns: costs from the start, by state, come forward to the middle turn, costs to the
end come back to it, they meet in the states that cost least together, and the two halves are solved for that crossing. Where several
states tie, one sweep back over the first half, which takes the first letter in ASCII order of the cheapest edits, carries along
which of them the least audit goes through.

Layout: turns are numbered by ranges (``order.numbered``), so one conversation may hold most rows. A block of ``BLOCK`` turns is a
string, one letter a turn. Conversations of more than one block meet in block matrices (cost from state to state): costs to the end
come down a tree of ``FAN`` blocks or groups of them, then the state each block begins in, and every block is solved by itself. Text
is shuffled by conversation and turn, and once more by conversation for the digest of the repaired text. That digest is one hash over
the whole conversation, so one task streams a conversation's text through it, a batch at a time; audits are one cell per conversation.

Defined results: nulls are one space, as in the damage; turns of equal number come by role, then text; other columns are not read; empty tables
give no rows; a conversation of which nothing is left has an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps, small_batches
from sessionmill.llm.order import numbered

BLOCK, FAN = 4096, 1024
SPACES = " \t\n\x0b\f\r"
INF = 1 << 60
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What an inserted or rerolled turn leads to:
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# Cost to the end behind the last turn: nothing, or inserted turns up to an assistant's.
END = (0, 2 * INSERT, INSERT, 0)


def _edits(code: str) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, cost, next state) of the edits that take a turn, letters ascending.

    ``code``: d a turn to delete; else the role's initial (x any other), in capitals if its text is cut off.
    """
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if code != "d":
            extra = CUT_OFF if code.isupper() else 0
            if (code.lower(), state) in KEPT:
                edits.append(("K", extra, KEPT[code.lower(), state]))
            edits.append(("R", REROLE + extra, NEXT[state]))
        out.append(edits)
    return out


EDITS = {code: _edits(code) for code in "dsuaxSUAX"}


def _back(code: str, after: list[int]) -> list[int]:
    """Costs to the end before a turn, by state, from those after it; turns may be inserted before it."""
    cost = [min(c + after[t] for _, c, t in edits) for edits in EDITS[code]]
    user, assistant = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, assistant]


def _least(code: str, state: int, before: list[int], after: list[int]) -> tuple[str, int, int]:
    """The edit at a turn that the least of the cheapest audits takes: letter, cost, next state."""
    for letter, cost, then in EDITS[code][state]:
        if letter != "D" and INSERT + before[NEXT[state]] == before[state]:
            break
        if cost + after[then] == before[state]:
            return letter, cost, then
    return "I", INSERT, NEXT[state]


def _forth(code: str, cost: list[int]) -> list[int]:
    """Costs from the start just after a turn, from those just after the one before."""
    user = min(cost[2], INSERT + min(cost[0], cost[1], cost[3]))
    assistant = min(cost[3], INSERT + user)
    out = [INF] * 4
    for state, spent in enumerate((cost[0], cost[1], user, assistant)):
        if spent < INF:
            for _, c, t in EDITS[code][state]:
                out[t] = min(out[t], spent + c)
    return out


def crossings(codes: str, lo: int, hi: int, after: list[int]) -> list[int]:
    """By state before turn ``lo``: the state just after turn ``hi - 1`` on the least of the cheapest audits."""
    through = [0, 1, 2, 3]
    for code in reversed(codes[lo:hi]):
        before, out = _back(code, after), []
        for state in range(4):
            letter, _, then = _least(code, state, before, after)
            while letter == "I":
                letter, _, then = _least(code, then, before, after)
            out.append(through[then])
        through, after = out, before
    return through


def matrix(codes: str) -> list[int]:
    """Least costs from each state before the turns to each state just after them, 16 numbers."""
    out = []
    for state in range(4):
        cost = [0 if s == state else INF for s in range(4)]
        for code in codes:
            cost = _forth(code, cost)
        out += cost
    return out


def solve(codes: str, entry: int, after: list[int]) -> tuple[str, int, int]:
    """Audit, cost and last state of the turns, begun in ``entry``, given the costs to the end by state behind them."""
    audit, total, state = [], 0, entry
    todo = [(0, len(codes), entry, after)] if codes else []
    while todo:
        lo, hi, state, after = todo.pop()
        if hi - lo == 1:
            before, letter = _back(codes[lo], after), ""
            while letter not in ("D", "K", "R"):
                letter, cost, state = _least(codes[lo], state, before, after)
                audit.append(letter)
                total += cost
            continue
        mid = (lo + hi) // 2
        here = [0 if s == state else INF for s in range(4)]
        for code in codes[lo:mid]:
            here = _forth(code, here)
        there = after
        for code in reversed(codes[mid:hi]):
            there = _back(code, there)
        meet = [a + b for a, b in zip(here, there, strict=True)]
        tied = [s for s in range(4) if meet[s] == min(meet)]
        cross = tied[0] if len(tied) == 1 else crossings(codes, lo, mid, there)[state]
        todo.append((mid, hi, cross, after))
        todo.append((lo, mid, state, [0 if s == cross else INF for s in range(4)]))
    return "".join(audit), total, state


def finish(state: int) -> str:
    """The inserts behind the last turn."""
    return "I" * (END[state] // INSERT)


class Rebuild:
    """The repaired turns of one conversation, as its turns and audits come."""

    def __init__(self) -> None:
        self.state = 0

    def inserted(self, letters: str) -> list[tuple[str, str]]:
        out = []
        for _ in letters:
            self.state = NEXT[self.state]
            out.append((ROLE[self.state], ""))
        return out

    def taken(self, letter: str, role: str, text: str) -> list[tuple[str, str]]:
        if letter == "D":
            return []
        if letter == "R":
            self.state = NEXT[self.state]
            return [(ROLE[self.state], text)]
        self.state = KEPT[role[:1], self.state]
        return [(role, text)]


# ---- rows ----


def damaged(conversations: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, copy: what the query's damage leaves. Nulls are one space in role and text, and in the key."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), F.coalesce(F.col("conv_id").cast("long").cast("string"), space).alias("key"),
    )
    kind = F.crc32(F.concat_ws(":", "key", F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank``, ``cut_off`` and ``same``, a digest of role and text."""
    stripped = F.trim(F.col("text"), F.lit(SPACES))
    return rows.select(
        "key", "turn", "role", "text", (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
    )


def faults(placed: DataFrame, steps: Steps) -> DataFrame:
    """(key, index, turn, initial, fault, code) of numbered turns; ``fault`` is the first: blank, duplicate, truncated or null."""
    firsts = placed.where("not blank").groupBy("key", "same").agg(F.min("index").alias("index")).select("key", "index", F.lit(True).alias("new"))
    # Written, so that the join has a plain shuffle on both sides. Its key is one row, however often a text comes back.
    rows = placed.select("key", "index", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut_off").join(steps.keep(firsts, "firsts"), ["key", "index"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut_off"), "truncated")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(known)).otherwise(known)
    return rows.select("key", "index", "turn", known.alias("initial"), fault.alias("fault"), code.alias("code"))


def _each(function: Callable, kind: str) -> Callable:
    """A pandas UDF that applies ``function`` to the values of each row."""

    @F.pandas_udf(kind)
    def mapped(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns, strict=True)], dtype=object)

    return mapped


# Functions of a group of blocks: their product, and what each is handed, given what the group is.
def _product(matrices: list) -> list[int]:
    left = [int(x) for x in matrices[0]]
    for right in matrices[1:]:
        left = [min(INF, min(left[4 * i + k] + int(right[4 * k + j]) for k in range(4))) for i in range(4) for j in range(4)]
    return left


def _ends(matrices: list, after: list[int]) -> list[list[int]]:
    out, after = [], [int(x) for x in after]
    for m in reversed(matrices):
        out.append(after)
        after = [min(int(m[4 * s + t]) + after[t] for t in range(4)) for s in range(4)]
    return out[::-1]


def _composed(maps: list) -> list[int]:
    state = [0, 1, 2, 3]
    for m in maps:
        state = [int(m[s]) for s in state]
    return state


def _entries(maps: list, entry: list[int]) -> list[list[int]]:
    out, state = [], int(entry[0])
    for m in maps:
        out.append([state])
        state = int(m[state])
    return out


def _handed(items: DataFrame, whole: Callable, each: Callable, start: list[int], most: int, steps: Steps, name: str, fan: int) -> DataFrame:
    """(key, node, given): what each of a key's items (key, node, value) is handed, the key as a whole being handed ``start``.

    Groups of ``fan`` items, and groups of those, up to one for a key: no task holds more than ``fan`` of them.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("node", "value"))), lambda x: x["value"])
    groups = items.groupBy("key", F.floor(F.col("node") / fan).alias("node")).agg(listed.alias("values"))
    if most <= fan:
        given = groups.withColumn("given", F.array(*(F.lit(x).cast("long") for x in start)))
    else:
        groups = steps.keep(groups, name)
        upper = groups.select("key", "node", _each(whole, "array<long>")("values").alias("value"))
        given = groups.join(_handed(upper, whole, each, start, -(-most // fan), steps, name + "-up", fan), ["key", "node"])
    parts = given.select("key", F.col("node").alias("up"), F.posexplode(_each(each, "array<array<long>>")("values", "given")).alias("pos", "given"))
    return parts.select("key", (F.col("up") * fan + F.col("pos")).alias("node"), "given")


def solved(turns: DataFrame, steps: Steps, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(key, node, audit, cost) of the blocks of ``faults``; the last block of a conversation has the inserts behind it."""
    listed = F.array_sort(F.collect_list(F.struct("index", "code")))
    blocks = turns.groupBy("key", F.floor(F.col("index") / block).alias("node")).agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes"))
    sizes = blocks.groupBy("key").agg(F.max("node").alias("last"))
    blocks = steps.keep(blocks, "blocks")
    blocks = steps.keep(blocks.join(steps.keep(sizes, "sizes"), "key"), "sized")
    most = (blocks.agg(F.max("last")).first()[0] or 0) + 1
    alone, many = blocks.where("last = 0"), blocks.where("last > 0")
    alone = alone.withColumns({"entry": F.array(F.lit(0).cast("long")), "after": F.array(*(F.lit(x).cast("long") for x in END))})
    if most > 1:
        costs = many.select("key", "node", _each(matrix, "array<long>")("codes").alias("value"))
        ends = _handed(steps.keep(costs, "costs"), _product, _ends, list(END), most, steps, "costs-up", fan)
        many = steps.keep(many.join(ends.withColumnRenamed("given", "after"), ["key", "node"]), "ends")
        maps = many.select("key", "node", _each(lambda codes, after: crossings(codes, 0, len(codes), [int(x) for x in after]), "array<long>")("codes", "after").alias("value"))
        entries = _handed(steps.keep(maps, "maps"), _composed, _entries, [0], most, steps, "maps-up", fan)
        alone = alone.unionByName(many.join(entries.withColumnRenamed("given", "entry"), ["key", "node"]))

    def solution(codes: str, entry: list[int], after: list[int], last: bool) -> dict:
        audit, cost, state = solve(codes, int(entry[0]), [int(x) for x in after])
        more = finish(state) if last else ""
        return {"audit": audit + more, "cost": cost + INSERT * len(more)}

    @F.pandas_udf("audit string, cost long")
    def solutions(codes: pd.Series, entry: pd.Series, after: pd.Series, last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([solution(*row) for row in zip(codes, entry, after, last, strict=True)], columns=["audit", "cost"])

    found = alone.select("key", "node", solutions("codes", "entry", "after", F.col("node") == F.col("last")).alias("s"))
    return steps.keep(found.select("key", "node", "s.audit", "s.cost"), "solved")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256) from turns and audits in order: a block's audit stands before its turns."""
    key, digest, build, letters, any_yet = None, None, None, iter(""), False

    def feed(turns: list[tuple[str, str]]) -> None:
        nonlocal any_yet
        for role, text in turns:
            digest.update((("\n" if any_yet else "") + f"{role}:{text}").encode())
            any_yet = True

    def rest() -> None:
        feed(build.inserted("".join(letters)))

    for batch in batches:
        out = []
        for k, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")), strict=True):
            if k != key:
                if key is not None:
                    rest()
                    out.append((key, digest.hexdigest()))
                key, digest, build, any_yet = k, hashlib.sha256(), Rebuild(), False
            if audit is not None:
                letters = iter(audit)
                continue
            letter = next(letters)
            while letter == "I":
                feed(build.inserted("I"))
                letter = next(letters)
            feed(build.taken(letter, role, text))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["key", "repaired_sha256"])
    if key is not None:
        rest()
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])


def repaired(conversations: DataFrame, steps: Steps | None = None, block: int = BLOCK, fan: int = FAN, damage: Callable = damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``damage`` gives the turns to repair, with the columns of ``damaged``.
    """
    steps = steps or Steps(conversations.sparkSession)
    small_batches(conversations.sparkSession)
    placed = numbered(_flagged(damage(conversations)), ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], steps, "placed")
    turns = steps.keep(faults(placed, steps), "turns")
    found = solved(turns, steps, block, fan)

    texts = placed.select("key", "index", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "role", "text")
    none = F.lit(None).cast("string")
    audits = found.select("key", (F.col("node") * block).alias("index"), F.lit(0).alias("kind"), "audit", none.alias("role"), none.alias("text"))
    stream = texts.unionByName(audits).repartition("key").sortWithinPartitions("key", "index", "kind")
    digests = steps.keep(stream.mapInArrow(_digests, "key string, repaired_sha256 string"), "digests")

    def total(fault: str) -> Column:
        return F.sum((F.col("fault") == fault).cast("long")).alias(fault)

    counts = turns.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.coalesce(total(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    edge = turns.groupBy("key", F.floor(F.col("index") / block).alias("node")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "initial"))), lambda x: x["initial"]), "").alias("initials")
    )
    before = F.lag(F.right("initials", F.lit(1)), 1, "").over(Window.partitionBy("key").orderBy("node"))
    line = F.concat(before, F.col("initials"))
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length("line"), F.lit(1))), lambda i: (i < F.char_length("line")) & ~F.substring(F.col("line"), i, F.lit(2)).isin("su", "ua", "au"))
    illegal = edge.select("key", line.alias("line")).select("key", F.size(pairs).alias("n")).groupBy("key").agg(F.sum("n").alias("illegal"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "audit"))), lambda x: x["audit"]), "")
    audit = found.groupBy("key").agg(F.sum("cost").alias("cost"), joined.alias("audit"))

    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    for part in (counts, illegal, audit, digests):
        every = every.join(part, "key", "left")
    zero = F.lit(0).cast("long")
    return every.select(
        "conv_id", *(F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
