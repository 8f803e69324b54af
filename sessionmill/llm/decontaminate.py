"""Benchmark decontamination by greedy string tiling.

A document holds a benchmark item if tiles cover enough of the item: runs of at least ``SEED`` words that both have, no word in two
tiles, the longest first. Passages whose parts were moved about are caught, as tiles may lie in any order.

The index of the benchmark's runs of ``SEED`` words meets every whole document where it is read. A document whose shared runs
could not cover enough of an item is passed over (each run of ``SEED`` words covers ``SEED`` at most); for the others tiles are
found by running Karp-Rabin: fingerprints of s unmarked words of the item are looked up in the document, matches are
extended and marked from the longest on, and s halves down to ``SEED``.

Scale: nothing is shuffled. The benchmark travels in blocks of about ``BLOCK_BYTES`` of its text, chosen by hash; each block is
one more pass over the documents, so what is broadcast never grows. Words are lower-cased in A-Z, without punctuation at
their ends.

Defined results: a null or empty text holds nothing; items with fewer than ``SEED`` words or a null text are in no document;
repeated items count as one id; items without an id are looked for as the others, and stand as one null, last, among the ids;
repeated rows are judged once each; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import small_batches, texts
from sessionmill.llm.text import U64, Words, joined, mix, powers, run_hash, slices, words

SEED = 5
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\"'()[]{}")] = True
_FILTER_BITS = 24
_BASE = 0x9E3779B97F4A7C15


def plain(w: Words) -> np.ndarray:
    """Hashes of the words without punctuation at their ends; a word of nothing else keeps it."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        more = (end - start > 1) & _ENDS[w.data[end - 1]] if len(end) else np.zeros(0, bool)
        end[more] -= 1
        more = (end - start > 1) & _ENDS[w.data[start]] if len(end) else np.zeros(0, bool)
        start[more] += 1
    return run_hash(w.data, start, end)


def fingerprints(tokens: np.ndarray, s: int) -> np.ndarray:
    """One for each run of ``s`` tokens, each from its neighbour's prefix sums."""
    n = len(tokens)
    if n < s:
        return np.zeros(0, U64)
    up, down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(tokens * up, dtype=U64)])
    return mix((total[s:] - total[:-s]) * down[: n - s + 1])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, length) of the tiles; of equals the first in the item, then in the document."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out, s = [], len(item)
    while s >= least:
        a, b = fingerprints(item, s), fingerprints(doc, s)
        # Runs of unmarked tokens only.
        marked = np.concatenate([[0], np.cumsum(~free_item)])
        i = np.flatnonzero(marked[s:] == marked[:-s]) if len(a) else np.zeros(0, int)
        marked = np.concatenate([[0], np.cumsum(~free_doc)])
        j = np.flatnonzero(marked[s:] == marked[:-s]) if len(b) else np.zeros(0, int)
        order = i[np.argsort(a[i], kind="stable")]
        low, high = np.searchsorted(a[order], b[j], "left"), np.searchsorted(a[order], b[j], "right")
        n = high - low
        if n.sum():
            y = np.repeat(j, n)
            x = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            # Neighbours on one diagonal are one longer match.
            o = np.lexsort((x, y - x))
            x, y = x[o], y[o]
            head = np.ones(len(x), bool)
            head[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
            at = np.flatnonzero(head)
            length = np.diff(at, append=len(x)) + s - 1
            queue = [(-int(l), int(p), int(q)) for l, p, q in zip(length, x[at], y[at], strict=True)]
            heapq.heapify(queue)
            while queue:
                l, p, q = heapq.heappop(queue)
                free = free_item[p : p - l] & free_doc[q : q - l]
                if free.all():
                    if (item[p : p - l] == doc[q : q - l]).all():
                        out.append((p, q, -l))
                        free_item[p : p - l] = free_doc[q : q - l] = False
                    continue
                edge = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0))
                for c, d in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if d - c >= s:
                        heapq.heappush(queue, (c - d, p + c, q + c))
        if s == least:
            break
        s = max(s // 2, least)
    return out


class Index:
    """Runs of ``SEED`` words of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        w = words(*joined(pa.array([t for _, t in items], pa.string())))
        h = plain(w)
        self.ids = [i for i, _ in items]
        self.tokens = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        runs = [fingerprints(t, SEED) for t in self.tokens]
        every = np.concatenate(runs) if runs else np.zeros(0, U64)
        of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        # Each run once per item, with how often it is there.
        pairs, n = np.unique(np.stack([every, of.astype(U64)], axis=1), axis=0, return_counts=True) if len(every) else (np.zeros((0, 2), U64), np.zeros(0, int))
        self.runs, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.item, self.weight = pairs[:, 1].astype(np.int64), n
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.runs >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.need = np.array([COVERAGE * len(t) / SEED for t in self.tokens])


def held(index: Index, doc: np.ndarray) -> list[tuple[int, float, int]]:
    """(item, coverage, number of tiles) of the items that a document's words hold."""
    runs = fingerprints(doc, SEED)
    at = np.flatnonzero(index.filter[(runs >> U64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at):
        return []
    place = np.minimum(np.searchsorted(index.runs, runs[at]), len(index.runs) - 1)
    hit = index.runs[place] == runs[at]
    at, place = at[hit], place[hit]
    if not len(at):
        return []
    known = np.unique(place)
    size = index.first[known + 1] - index.first[known]
    rows = np.repeat(index.first[known] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    shared = np.bincount(index.item[rows], weights=index.weight[rows], minlength=len(index.tokens))
    able = np.flatnonzero((shared >= index.need) & (shared > 0))
    if not len(able):
        return []
    # The words under a hit, runs of them kept apart by words that no item has.
    under = np.zeros(len(doc) + 1, np.int64)
    np.add.at(under, at, 1)
    np.add.at(under, at + SEED, -1)
    covered = np.cumsum(under)[:-1] > 0
    places = np.flatnonzero(covered)
    gap = np.flatnonzero(np.diff(places) > 1)
    compact = np.insert(doc[places], gap + 1, np.arange(1, len(gap) + 1, dtype=U64))
    out = []
    for item in able.tolist():
        found = tiles(index.tokens[item], compact)
        coverage = sum(l for _, _, l in found) / len(index.tokens[item])
        if coverage >= COVERAGE:
            out.append((item, coverage, len(found)))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of about ``BLOCK_BYTES``; a block is read when its turn comes."""
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null"
    )
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    for block in range(n):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).distinct()
        yield [(r["item_id"], r["text"]) for r in rows.collect()]


def id_order(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def judged(index: Index, column: pa.Array) -> list[list[tuple[int, float, int]]]:
    """What each text of a batch holds."""
    w = words(*joined(column))
    h, first = plain(w), w.first
    # A glance at all texts of the batch at once; few go on.
    glance = fingerprints(h, SEED)
    seen = np.flatnonzero(index.filter[(glance >> U64(64 - _FILTER_BITS)).astype(np.int64)])
    able = np.zeros(len(column), bool)
    able[w.doc[seen]] = True
    return [held(index, h[first[row] : first[row + 1]]) if able[row] else [] for row in range(len(column))]


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no item."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items))

        def run(batches, index=index):
            for batch in slices(batches):
                yield batch.filter(pa.array([not found for found in judged(index.value, batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document: whether it holds an item, the best covered one, and all that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    # What earlier blocks of items have found goes along with the text.
    out = texts(docs).selectExpr(
        "doc_id", "text", "cast(null as long) item_id", "cast(0 as double) coverage", "0 n_tiles", "cast(array() as array<long>) items"
    )
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items))

        def run(batches, index=index):
            for batch in slices(batches):
                results = judged(index.value, batch.column("text"))
                before = [batch.column(c).to_pylist() for c in ("item_id", "coverage", "n_tiles", "items")]
                rows = []
                for row in range(batch.num_rows):
                    best, coverage, n_tiles, known = (c[row] for c in before)
                    found = results[row]
                    for item, covered, n in found:
                        number = index.value.ids[item]
                        if not n_tiles or (-covered, id_order(number)) < (-coverage, id_order(best)):
                            best, coverage, n_tiles = number, covered, n
                    rows.append((best, coverage, n_tiles, sorted({*known, *(index.value.ids[i] for i, _, _ in found)}, key=id_order)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()),
                     pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))],
                    ["doc_id", "text", "item_id", "coverage", "n_tiles", "items"],
                )

        out = out.mapInArrow(run, "doc_id long, text string, item_id long, coverage double, n_tiles int, items array<long>")
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "item_id", "coverage", "n_tiles", "items")
