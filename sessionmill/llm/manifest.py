"""Merkle manifest of a dataset whose nodes keep the hash states before each child.

Rows of a source, by id, are the leaves of its tree; a node hashes the digests of ``FAN`` consecutive ones below, and the roots of the
sources, by name, are the leaves of one more tree. Beside its digest a node keeps the SHA-256 state before each child slot, 32
bytes each, copied while the node is first hashed. To see what a changed row makes of the root, each node on the way up takes
the state before the row's slot, hashes the replacement and the siblings to its right, and closes: no left sibling is read, no
node is hashed from its start.

Layout: text is read where it is hashed and never shuffled. Leaves are numbered by ranges (``order.numbered``), so one source
with most rows is spread over all tasks. A level is one grouping of at most ``FAN`` rows a key, written, which cuts the lineage; levels
shrink sixteenfold. The way to the root is handed down level by level, a join of each node with its parent, so no key
meets more than ``FAN`` rows, the root's included. Rows are folded per lowest node, vectorised over a batch of nodes.

Defined results: a null value is `-`; rows without an id come first, then equal ids by leaf; equal rows are leaves of their own; a
row without an id is not tampered with by the query; the empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm import sha
from sessionmill.llm.frames import Steps, fold, small_batches
from sessionmill.llm.order import numbered

FAN_BITS = 4
FAN = 1 << FAN_BITS
STATE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """A row's digest as text; ``instead`` has columns that take the place of fields."""
    return F.sha2(F.concat(*(_field(instead.get(name, F.col(name))) for name in FIELDS)), 256)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and ``replaced``, the leaf of the row with ``changed`` for its text where that is not null."""
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(text=changed))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("leaf"), other.alias("replaced")
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and kept states of nodes, given their children's digests as one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("children").to_pylist()
        size = np.array([len(r) // 64 for r in runs])
        order = np.argsort(-size, kind="stable")
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[order]
        blocks, size = sha.as_blocks("".join(runs).encode()), size[order]
        state = np.repeat(sha.START[:, None], len(runs), axis=1)
        kept = np.zeros((len(runs), FAN, 8), sha.U32)
        for slot in range(int(size[0])):
            live = int(np.searchsorted(-size, -slot, side="left"))  # runs with more children than this
            kept[:live, slot] = state[:, :live].T
            state[:, :live] = sha.step(state[:, :live], blocks[first[:live] + slot].T)
        digests, back = sha.text_of(sha.as_hex(sha.closed(state, size))), np.argsort(order)
        raw = kept.astype(">u4").view(np.uint8).reshape(len(runs), FAN * STATE)
        states = [raw[i, : size[i] * STATE].tobytes() for i in back]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([digests[i] for i in back]), pa.array(states, pa.binary())], names=[*batch.schema.names, "digest", "states"]
        )


def _parents(level: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(tree, height, node, children, digest, states) of the nodes above (tree, height, node, digest); ``carried`` columns of the
    level are kept as ``members``, in the children's order."""
    below = F.array_sort(F.collect_list(F.struct(*dict.fromkeys(("node", "digest", *carried)))))
    runs = level.groupBy("tree", "height", F.shiftright("node", FAN_BITS).alias("node")).agg(below.alias("below"))
    runs = runs.select(
        "tree", "height", "node", F.array_join(F.transform("below", lambda c: c["digest"]), "").alias("children"),
        *([F.transform("below", lambda c: F.struct(*(c[name].alias(name) for name in carried))).alias("members")] if carried else []),
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields]
    return runs.mapInArrow(_hash_runs, ", ".join([*fields, "digest string", "states binary"]))


def _height(count: Column) -> Column:
    """Levels above the leaves of a tree."""
    bounds = [FAN**h for h in range(1, 16)]
    return reduce(lambda above, h: F.when(count <= bounds[h - 1], h).otherwise(above), range(15, 0, -1), F.lit(16)) * (count > 1).cast("int")


class Manifest:
    """Tables of one manifest: ``levels[h]`` has the nodes ``h`` levels above the leaves, of the trees that are at least so high;
    ``trees`` the sources' roots with the steps from there to the ``root``; ``lone`` the trees of one leaf."""

    def __init__(self, rows: DataFrame, steps: Steps) -> None:
        small_batches(rows.sparkSession)
        self.steps = steps
        hashed = steps.keep(rows.withColumn("tree", _field(F.col("source"))), "leaves")
        placed = numbered(hashed, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], steps, "placed")
        counts = placed.groupBy("tree").agg(F.count("*").alias("n"), F.first("source").alias("source"))
        counts = steps.keep(counts.select("tree", "source", _height(F.col("n")).alias("height")), "counts")
        placed = placed.join(counts.drop("source"), "tree").withColumnsRenamed({"index": "node", "leaf": "digest"})
        self.lone = placed.where("height = 0")
        self.levels = self._grow(placed.where("height > 0"), counts.agg(F.max("height")).first()[0] or 0, "level", ("doc_id", "digest", "replaced"))
        tops = reduce(DataFrame.unionByName, [level.where(F.col("height") == h).select("tree", "digest") for h, level in self.levels.items()], self.lone.select("tree", "digest"))
        self.trees = self._to_root(tops.join(counts, "tree"))

    def _grow(self, level: DataFrame, high: int, name: str, carried: tuple[str, ...] = ()) -> dict[int, DataFrame]:
        out = {}
        for h in range(1, high + 1):
            out[h] = self.steps.keep(_parents(level, carried if h == 1 else ()), f"{name}-{h}")
            level = out[h].where(F.col("height") > h).select("tree", "height", "node", "digest")
        return out

    def _to_root(self, tops: DataFrame) -> DataFrame:
        """(tree, height, digest, path) of the sources; the tree above them is grown by the same steps."""
        ranked = numbered(tops.withColumn("one", F.lit(0)), ["one"], [F.col("source").asc_nulls_first()], self.steps, "sources")
        ranked = self.steps.keep(ranked.drop("one"), "ranked")
        n = ranked.count()
        high = next(h for h in range(17) if FAN**h >= n) if n else 0
        leaf_level = ranked.select(F.lit("").alias("tree"), F.lit(high).alias("height"), F.col("index").alias("node"), "digest")
        forest = self._grow(leaf_level, high, "forest")
        top = forest[high] if high else leaf_level
        self.root = (top.first() or {"digest": None})["digest"]
        above = _descend(forest, None)
        none = F.array().cast("array<struct<slot: int, state: binary, children: string>>")
        ranked = ranked.select("tree", "height", "digest", F.shiftright("index", FAN_BITS).alias("up"), F.col("index").bitwiseAND(FAN - 1).cast("int").alias("slot"))
        if not high:
            return ranked.select("tree", "height", "digest", none.alias("path"))
        joined = ranked.join(above.select(F.col("node").alias("up"), "states", "children", "path"), "up")
        return joined.select("tree", "height", "digest", F.concat(F.array(_step(F.col("slot"))), F.col("path")).alias("path"))

    def rows(self) -> DataFrame:
        """Every lowest node with its members (one, for a lone leaf) and the steps to the root."""
        alone = self.lone.join(self.trees.select("tree", "path"), "tree").select(
            F.array(F.struct("doc_id", "digest", "replaced")).alias("members"), F.lit(None).cast("string").alias("children"),
            F.lit(None).cast("binary").alias("states"), "path", F.col("digest").alias("subroot"),
        )
        if not self.levels:
            return alone
        low = _descend(self.levels, self.trees)
        return low.select("members", "children", "states", "path", "subroot").unionByName(alone)


def _step(slot: Column) -> Column:
    """What a fold needs of a node: the child's slot, the state before it, and the children."""
    return F.struct(slot.alias("slot"), F.substring("states", slot * STATE + 1, F.lit(STATE)).alias("state"), F.col("children"))


def _descend(levels: dict[int, DataFrame], trees: DataFrame | None) -> DataFrame:
    """The lowest level's nodes, each with ``path``, the steps from it to the root, and its tree's ``subroot``."""
    none = F.array().cast("array<struct<slot: int, state: binary, children: string>>")
    known = None
    for h in sorted(levels, reverse=True):
        level = levels[h]
        tops = level.where(F.col("height") == h)
        if trees is None:
            tops = tops.withColumn("path", none).withColumn("subroot", F.col("digest"))
        else:
            tops = tops.join(trees.select("tree", "path"), "tree").withColumn("subroot", F.col("digest"))
        if known is not None:
            up = known.select("tree", F.col("node").alias("_up"), F.col("states").alias("_s"), F.col("children").alias("_c"), F.col("path").alias("_p"), "subroot")
            slot = F.col("node").bitwiseAND(FAN - 1).cast("int")
            step = F.struct(slot.alias("slot"), F.substring("_s", slot * STATE + 1, F.lit(STATE)).alias("state"), F.col("_c").alias("children"))
            under = level.where(F.col("height") > h).withColumn("_up", F.shiftright("node", FAN_BITS)).join(up, ["tree", "_up"])
            tops = tops.unionByName(under.withColumn("path", F.concat(F.array(step), "_p")).drop("_up", "_s", "_c", "_p"))
        known = tops
    return known


def _resume(words: np.ndarray, states: np.ndarray, slots: np.ndarray, size: np.ndarray, first: np.ndarray, siblings: np.ndarray) -> np.ndarray:
    """New digests of nodes, as text words: the state before the slot, the replacement, the siblings to its right, the end."""
    state = sha.step(np.ascontiguousarray(states.T), np.ascontiguousarray(words.T))
    for ahead in range(1, FAN):
        live = np.flatnonzero(slots + ahead < size)
        if not len(live):
            break
        state[:, live] = sha.step(state[:, live], siblings[first[live] + slots[live] + ahead].T)
    return sha.as_hex(sha.closed(state, size))


def _states(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u4").astype(sha.U32).reshape(-1, 8)


def _fold_batch(rows: list[dict]) -> list[tuple]:
    """(doc_id, leaf, subroot, proof, folded) of the rows of some lowest nodes."""
    members = [(run, place, m) for run, r in enumerate(rows) for place, m in enumerate(r["members"])]
    run = np.array([m[0] for m in members])
    words = sha.as_blocks("".join(m[2]["replaced"] or m[2]["digest"] for m in members).encode())
    proofs = [hashlib.sha256() for _ in members]
    high = max(len(r["path"]) for r in rows)
    for level in range(high + 1):
        if level == 0:
            used = [(i, r["children"], r["states"]) for i, r in enumerate(rows) if r["children"] is not None]
        else:
            used = [(i, r["path"][level - 1]["children"], r["path"][level - 1]["state"]) for i, r in enumerate(rows) if len(r["path"]) >= level]
        if not used:
            continue
        place = np.full(len(rows), -1)
        place[[u[0] for u in used]] = np.arange(len(used))
        live = np.flatnonzero(place[run] >= 0)
        size = np.array([len(u[1]) // 64 for u in used])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        siblings, at = sha.as_blocks("".join(u[1] for u in used).encode()), place[run[live]]
        if level == 0:
            slots = np.array([members[i][1] for i in live])
            states = _states([u[2] for u in used])[first[at] + slots]
        else:
            slots = np.array([rows[u[0]]["path"][level - 1]["slot"] for u in used])[at]
            states = _states([u[2] for u in used])[at]
        for i, k, slot in zip(live.tolist(), at.tolist(), slots.tolist(), strict=True):
            text = used[k][1].encode()
            proofs[i].update(text[: slot * 64])
            proofs[i].update(text[slot * 64 + 64 :])
        # Rows of a node that did not change meet again above it: each different digest is folded once.
        seen = np.ascontiguousarray(np.concatenate([at[:, None].astype(sha.U32), slots[:, None].astype(sha.U32), words[live]], axis=1))
        _, one, back = np.unique(seen.view(np.dtype((np.void, seen.itemsize * seen.shape[1]))).ravel(), return_index=True, return_inverse=True)
        words[live] = _resume(words[live][one], states[one], slots[one], size[at[one]], first[at[one]], siblings)[back]
    folded = sha.text_of(words)
    return [(m["doc_id"], m["digest"], rows[i]["subroot"], proofs[k].hexdigest(), folded[k]) for k, (i, _, m) in enumerate(members)]


FOLDED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        if batch.num_rows:
            out = list(zip(*_fold_batch(batch.to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in FOLDED.split(", ")])


def verified(rows: DataFrame, steps: Steps | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of ``leaves``: what the root is once the row is replaced."""
    manifest = Manifest(rows, steps or Steps(rows.sparkSession))
    folded = manifest.rows().mapInArrow(_fold, FOLDED)
    root = F.lit(manifest.root).cast("string")
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered(docs: DataFrame) -> Column:
    """The query's damage: the text in lower case A-Z where 5 divides the id's checksum; else null."""
    return F.when(fold("doc_id", 5) == 0, F.translate(F.col("text").cast("string"), UPPER, LOWER))
