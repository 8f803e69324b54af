"""Removal of byte strings that stand earlier too, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or before in
the same one. All strings are judged on the input. Sorting every suffix of all texts at once would need many times the
texts' size, so suffixes are sorted one bucket at a time, and only those that can have a partner:

1. Every string of ``LENGTH`` bytes is known by its anchor: of its windows of ``GRAM`` bytes the one with the smallest hash, the
   first of equals. Equal strings have equal anchors at equal places. Anchors (one in about 35 bytes) go to buckets
   by a second hash, since the smallest of many hashes are far from evenly spread; those found once are dropped.
2. Texts with other anchors send each anchor's surroundings, the bytes of the strings known by it, to the anchor's
   bucket. Equal surroundings are one, first among the ``FLUSH_ROWS`` anchors of a task that are sent together, where all
   but the earliest become spans at once, then in the bucket. A bucket holds suffixes that begin at most ``REACH`` before an anchor.
3. A bucket's suffixes are sorted in blocks. Suffixes are compared on 16 bytes; longer ties are resolved by the
   precomputed ranks of a difference-cover sample (residues ``COVER`` modulo ``PERIOD``), which exist for a fifth of the
   places only. Neighbours in this order that agree on ``LENGTH`` bytes are the same string; all but the earliest start go.
   Buckets of two suffixes need no ranks: one comparison orders them.

Texts that are equal in whole are one class first: all but the earliest go in whole if they have ``LENGTH`` bytes.

Scale: texts are shuffled twice, to meet their anchors and to meet their spans; all else moves as packed blocks.
There is a bucket for every ``BUCKET_BYTES`` of text, so a bucket does not grow with the input. A passage that many texts
share reaches its bucket once from every ``FLUSH_ROWS`` anchors. A block is bounded by ``BLOCK_ROWS`` unless one anchor has more
different surroundings.

Defined results: null and empty texts have 0 bytes and no spans; a null id comes after all others; rows with one id are
ordered by a hash of their text, and rows equal in id and text are one document, each with its result; other columns are
not read. A cut inside a code point leaves its other bytes as they are; the digest is of bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps, small_batches, texts
from sessionmill.llm.text import U64, joined, mix, pack, pack_sorted, powers, rolling, slices, unpack, unpack_sorted

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # an anchor begins at most so far after its string
WIDTH = REACH + LENGTH
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two members of the cover
STRIDE = 186  # WIDTH and zeros up to a multiple of PERIOD
BLOCK_ROWS = 8192
BUCKET_BYTES = 8 << 20
_SPREAD = U64(0x6A09E667F3BCC909)
CHUNK_BYTES, FLUSH_ROWS, SLICE_BYTES = 8 << 20, 1 << 14, 1 << 19

EMITTED = (
    "bucket int, chunk long, hashes binary, owners binary, places binary, before binary, after binary,"
    " doc_id array<long>, text_hash array<long>"
)
FOUND = "node long, place array<int>, before array<int>, after array<int>"
SURROUNDINGS = "bucket int, blobs array<binary>"
SPANS = "doc_id long, text_hash long, begin array<int>, end array<int>"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor, and the first and last string known by it; places are those in ``data``."""
    n = len(data)
    nothing = (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    if n < LENGTH:
        return nothing
    h = mix(rolling(data, GRAM))
    # A string lies in one text.
    ok = np.zeros(n + 1, dtype=np.int8)
    long = np.diff(offsets) >= LENGTH
    ok[offsets[:-1][long]] += 1
    ok[offsets[1:][long] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    if not len(start):
        return nothing
    least, width = h, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    low = least[start]
    # Places that are the smallest of some string; equal hashes are sorted out below.
    top = np.zeros(len(h), dtype=U64)
    top[start] = low
    top, width = np.concatenate([np.zeros(REACH, U64), top]), 1
    while 2 * width <= REACH + 1:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    rest = REACH + 1 - width
    top = np.maximum(top[: len(top) - rest], top[rest:]) if rest else top
    places = np.flatnonzero(top == h)
    at = np.searchsorted(places, start)
    open_ = np.flatnonzero(h[places[at]] != low)
    while len(open_):
        at[open_] += 1
        open_ = open_[h[places[at[open_]]] != low[open_]]
    place = places[at]
    head = np.flatnonzero(np.diff(place, prepend=-1))
    tail = np.append(head[1:], len(place)) - 1
    return mix(h[place[head]] + _SPREAD), place[head], start[head], start[tail]


def emit(batches, buckets: int):
    part, nth, size, held = TaskContext.get().partitionId(), 0, 0, []
    for batch in slices(batches, limit=SLICE_BYTES):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield from _chunk((part << 12) + nth, held, buckets)
            nth, size, held = nth + 1, 0, []
    if held:
        yield from _chunk((part << 12) + nth, held, buckets)


_EMITTED = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("hashes", "owners", "places", "before", "after")),
    ("doc_id", pa.list_(pa.int64())), ("text_hash", pa.list_(pa.int64())),
])


def _chunk(chunk: int, batches: list[pa.RecordBatch], buckets: int):
    parts, ids, tied, base = [], [], [], 0
    for batch in batches:
        data, offsets = joined(batch.column("text"))
        h, place, first, last = anchors(data, offsets)
        doc = np.searchsorted(offsets, place, side="right") - 1
        parts.append((h, doc + base, place - offsets[doc], place - first, place - last))
        ids += batch.column("doc_id").to_pylist()
        tied += batch.column("text_hash").to_pylist()
        base += batch.num_rows
    row = dict.fromkeys(_EMITTED.names) | {"chunk": chunk, "doc_id": ids, "text_hash": tied}
    yield pa.RecordBatch.from_pylist([row], _EMITTED)
    h, doc, place, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h = h[order]
    doc, place = doc[order].astype(np.uint32), place[order].astype(np.uint32)
    before, after = before[order].astype(np.uint8), after[order].astype(np.uint8)
    for bucket, i, j in dealt(h, buckets):
        row = dict.fromkeys(_EMITTED.names) | {
            "bucket": bucket, "chunk": chunk, "hashes": pack_sorted(h[i:j]), "owners": pack(doc[i:j]),
            "places": pack(place[i:j]), "before": pack(before[i:j]), "after": pack(after[i:j]),
        }
        yield pa.RecordBatch.from_pylist([row], _EMITTED)


def dealt(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Buckets that have hashes, with the first and last (exclusive) of them."""
    width = U64((1 << 64) // buckets + 1)
    of = (sorted_hashes // width).astype(np.int64)
    at = _grouped(of)
    return list(zip(of[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))


def _grouped(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets of runs of equal keys, the end included."""
    return np.append(np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), len(sorted_keys)) if len(sorted_keys) else np.zeros(1, np.int64)


def _list(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def repeated(table: pa.Table) -> pa.Table:
    """One bucket of anchors: those found more than once, by text."""
    columns = [[unpack(x.as_py()) for x in table.column(c)] for c in ("owners", "places", "before", "after")]
    h = np.concatenate([unpack_sorted(x.as_py()) for x in table.column("hashes")])
    node = np.concatenate([(np.int64(c) << 24) + o.astype(np.int64) for c, o in zip(table.column("chunk").to_pylist(), columns[0], strict=True)])
    place, before, after = (np.concatenate(c).astype(np.int32) for c in columns[1:])
    _, of, n = np.unique(h, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(n[of] > 1)
    keep = keep[np.argsort(node[keep], kind="stable")]
    at = _grouped(node[keep])
    return pa.table({
        "node": pa.array(node[keep][at[:-1]], pa.int64()), "place": _list(place[keep], at, pa.int32()),
        "before": _list(before[keep], at, pa.int32()), "after": _list(after[keep], at, pa.int32()),
    })


@dataclass
class Anchors:
    """Anchors with the bytes around them: their hash, document (id, id is null, hash of the text), place in it and strings."""

    h: np.ndarray
    around: np.ndarray
    ids: np.ndarray
    absent: np.ndarray
    tied: np.ndarray
    place: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @staticmethod
    def of(parts: list[Anchors]) -> Anchors:
        return Anchors(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Anchors)))

    def take(self, at: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, f.name)[at] for f in fields(Anchors)))

    def order_of_starts(self) -> np.ndarray:
        """Rank of each anchor's place among all; equal for one document handed over twice."""
        order = np.lexsort((self.place, self.tied, self.ids, self.absent))
        new = np.zeros(len(order), np.int64)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (self.absent, self.ids, self.tied, self.place)], axis=0)
        prior = np.empty(len(order), np.int64)
        prior[order] = np.cumsum(new)
        return prior

    def merge(self, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal surroundings are one: the rows that stay, by anchor, and those that go with all their strings as one of the
        former stands earlier. A row equal in place too is left out of both."""
        n = len(self.h)
        whole = np.zeros(n, dtype=U64)
        for column, factor in zip(np.ascontiguousarray(self.around).view(U64).T, powers(0x9E3779B97F4A7C15, WIDTH // 8), strict=True):
            whole += mix(column + factor)
        order = np.lexsort((prior, self.after, self.before, whole, self.h))
        a, b = order[1:], order[:-1]
        equal = np.zeros(n, dtype=bool)
        equal[1:] = (whole[a] == whole[b]) & np.all([x[a] == x[b] for x in (self.h, self.before, self.after)], axis=0)
        check = np.flatnonzero(equal)
        for i in range(0, len(check), FLUSH_ROWS):
            at = check[i : i + FLUSH_ROWS]
            equal[at] = (self.around[order[at]] == self.around[order[at - 1]]).all(axis=1)
        leader = order[np.maximum.accumulate(np.where(equal, 0, np.arange(n)))] if n else order
        return order[~equal], order[equal & (prior[order] > prior[leader])]


def surroundings(batches, buckets: int):
    """For each bucket, blocks of anchors with the bytes around them and where they stand; and spans found on the way."""
    part, nth, held, rows = TaskContext.get().partitionId(), 0, [], 0
    for batch in slices(batches, limit=SLICE_BYTES):
        for found in _around(batch):
            held.append(found)
            rows += len(found.h)
            if rows >= FLUSH_ROWS:
                yield from _flush(Anchors.of(held), buckets, part * 31 + nth)
                nth, held, rows = nth + 1, [], 0
    if rows:
        yield from _flush(Anchors.of(held), buckets, part * 31 + nth)


def _around(batch: pa.RecordBatch):
    """The anchors of a batch, at most ``FLUSH_ROWS`` at a time."""
    data, offsets = joined(batch.column("text"))
    lists = [batch.column(c) for c in ("place", "before", "after")]
    count = np.diff(lists[0].offsets.to_numpy())
    ends = np.cumsum(count)
    lists = [x.flatten().to_numpy() for x in lists]
    padded = np.concatenate([np.zeros(WIDTH, np.uint8), data, np.zeros(WIDTH, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
    column = np.arange(WIDTH, dtype=np.int16)
    ids = batch.column("doc_id")
    absent, ids = np.asarray(ids.is_null()).astype(np.uint8), ids.fill_null(0).to_numpy()
    tied = batch.column("text_hash").to_numpy()
    for i in range(0, len(lists[0]), FLUSH_ROWS):
        place, before, after = (x[i : i + FLUSH_ROWS].astype(np.int64) for x in lists)
        doc = np.searchsorted(ends, np.arange(i, i + len(place)), side="right")
        at = offsets[doc] + place
        around = windows[at + WIDTH - REACH]
        gram = np.ascontiguousarray(around[:, REACH : REACH + GRAM]).view(U64)
        h = np.zeros(len(at), dtype=U64)
        for word, factor in zip(gram.T, powers(0x9E3779B97F4A7C15, GRAM // 8), strict=True):
            h = mix(h + word * factor)
        # Only the strings known by the anchor: first begins REACH - before, last ends at REACH - after + LENGTH.
        around[(column < (REACH - before)[:, None]) | (column >= (REACH - after + LENGTH)[:, None])] = 0
        yield Anchors(
            h, around, ids[doc], absent[doc], tied[doc], place.astype(np.uint32), before.astype(np.uint8), after.astype(np.uint8)
        )


_ZSTD = pa.Codec("zstd", compression_level=3)


def _flush(found: Anchors, buckets: int, any_bucket: int):
    """Blocks by bucket, eight blobs each; spans as one block of five blobs, which may go to any bucket."""
    kept, gone = found.merge(found.order_of_starts())
    if len(gone):
        begin, end = _strings(found, gone, REACH - found.before[gone].astype(np.int64), REACH - found.after[gone].astype(np.int64))
        blobs = [pack(x) for x in (found.ids[gone], found.absent[gone], found.tied[gone], begin.astype(np.int32), end.astype(np.int32))]
        yield _block(any_bucket % buckets, blobs)
    found = found.take(kept)  # sorted by hash
    for bucket, i, j in dealt(found.h, buckets):
        blobs = [pack_sorted(found.h[i:j]), _ZSTD.compress(found.around[i:j].tobytes(), asbytes=True)]
        yield _block(bucket, blobs + [pack(getattr(found, f.name)[i:j]) for f in fields(Anchors)[2:]])


def _block(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blobs], pa.list_(pa.binary()))], ["bucket", "blobs"])


def _strings(found: Anchors, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in the document of the strings at offsets ``first`` to ``last`` around anchors."""
    place = found.place[rows].astype(np.int64)
    return place - REACH + first, place - REACH + last + LENGTH


def cover_ranks(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at the cover's places of each row, by their first 4 * PERIOD bytes; and the places.

    Names of PERIOD bytes come first; a suffix at distance PERIOD is again at a place of the cover, so pairs of names are
    names of twice the length. Behind a row's end there are zeros only.
    """
    rows = len(around)
    places = np.array([p for p in range(0, STRIDE) if p % PERIOD in COVER])
    windows = np.zeros((rows, STRIDE + 32), np.uint8)
    windows[:, :WIDTH] = around
    names = np.zeros(rows * len(places), np.int64)
    for first in range(0, PERIOD, 8):
        width = min(8, PERIOD - first)
        word = np.zeros((rows, len(places)), U64)
        for b in range(width):
            word = (word << U64(8)) | windows[:, places + first + b].astype(U64)
        names = _pair_names(names, word.ravel())
    per = len(COVER)
    for jump in (1, 2):
        ahead = np.zeros((rows, len(places)), np.int64)
        ahead[:, : len(places) - jump * per] = names.reshape(rows, -1)[:, jump * per :] + 1
        names = _pair_names(names, ahead.ravel())
    return names.reshape(rows, -1), places


def _pair_names(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    new = np.ones(len(a), dtype=np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def sort_block(around: np.ndarray, valid: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """For each row and string offset: does the same string start earlier? ``valid``: which strings are the row's."""
    out = np.zeros(valid.shape, dtype=bool)
    ranks, places = cover_ranks(around)
    words = np.zeros((len(around), WIDTH + 8), np.uint8)
    words[:, :WIDTH] = around
    for offset in range(REACH + 1):
        rows = np.flatnonzero(valid[:, offset])
        if len(rows) < 2:
            continue
        next_place = int(np.searchsorted(places, offset))
        first = np.ascontiguousarray(words[rows, offset : offset + 8]).view(">u8").ravel()
        second = np.ascontiguousarray(words[rows, offset + 8 : offset + 16]).view(">u8").ravel()
        order = rows[np.lexsort((prior[rows], ranks[rows, next_place], second, first))]
        string = around[order, offset : offset + LENGTH]
        same = (string[1:] == string[:-1]).all(axis=1)
        head = np.concatenate([[0], np.flatnonzero(~same) + 1])
        size = np.diff(head, append=len(order))
        earliest = np.repeat(np.minimum.reduceat(prior[order], head), size)
        out[order, offset] = prior[order] > earliest
    return out


def _opened(table: pa.Table) -> tuple[Anchors, list[list[np.ndarray]]]:
    """All anchors of a bucket, and blocks of spans that came along. The bytes are unpacked into their place one by one."""
    blocks, spans_ = [], []
    for blobs in table.column("blobs"):
        blobs = [x.as_py() for x in blobs]
        if len(blobs) == 5:
            spans_.append([unpack(b) for b in blobs])
        else:
            blocks.append((unpack_sorted(blobs[0]), blobs[1], *(unpack(b) for b in blobs[2:])))
    around, at = np.empty((sum(len(b[0]) for b in blocks), WIDTH), np.uint8), 0
    for block in blocks:
        n = len(block[0])
        around[at : at + n] = np.frombuffer(_ZSTD.decompress(block[1], n * WIDTH, asbytes=True), np.uint8).reshape(-1, WIDTH)
        at += n
    kinds = (U64, None, np.int64, np.uint8, np.int64, np.uint32, np.uint8, np.uint8)
    columns = [np.concatenate([np.zeros(0, k), *(b[c] for b in blocks)]) if k else around for c, k in enumerate(kinds)]
    return Anchors(*columns), spans_


def resolve(table: pa.Table) -> pa.Table:
    """One bucket of surroundings: spans that stand earlier too, by document."""
    found, ready = _opened(table)
    h, around, prior = found.h, found.around, found.order_of_starts()
    before, after = found.before.astype(np.int64), found.after.astype(np.int64)
    rows, follows = found.merge(prior)
    gone, first, last = [follows], [REACH - before[follows]], [REACH - after[follows]]
    at = _grouped(h[rows])
    sizes = np.diff(at)

    def note(block: np.ndarray, hit: np.ndarray) -> None:
        """Runs of strings that go, as first and last offset."""
        if not hit.any():
            return
        edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
        r, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        gone.append(block[r])
        first.append(begin)
        last.append(end - 1)

    offsets = np.arange(REACH + 1)

    def own(block: np.ndarray) -> np.ndarray:
        return (offsets >= (REACH - before[block])[:, None]) & (offsets <= (REACH - after[block])[:, None])

    two = at[:-1][sizes == 2]
    for i in range(0, len(two), BLOCK_ROWS):
        x, y = rows[two[i : i + BLOCK_ROWS]], rows[two[i : i + BLOCK_ROWS] + 1]
        agree = np.zeros((len(x), WIDTH + 1), np.int16)
        np.cumsum(around[x] == around[y], axis=1, out=agree[:, 1:])
        same = (agree[:, LENGTH:] - agree[:, : REACH + 1] == LENGTH) & own(x) & own(y)
        later = np.where(prior[x] > prior[y], x, y)
        note(later, same & (prior[x] != prior[y])[:, None])
    many = np.flatnonzero(sizes > 2)
    i = 0
    while i < len(many):
        j, total = i, 0
        while j < len(many) and (j == i or total + sizes[many[j]] <= BLOCK_ROWS):
            total += sizes[many[j]]
            j += 1
        block = np.concatenate([rows[at[m] : at[m + 1]] for m in many[i:j]])
        note(block, sort_block(around[block], own(block), prior[block]))
        i = j
    gone, first, last = np.concatenate(gone), np.concatenate(first), np.concatenate(last)
    ready.append([found.ids[gone], found.absent[gone], found.tied[gone], *_strings(found, gone, first, last)])
    ids, absent, tied, begin, end = (np.concatenate(x) for x in zip(*ready, strict=True))
    order = np.lexsort((begin, tied, ids, absent))
    ids, absent, tied, begin, end = (x[order] for x in (ids, absent, tied, begin, end))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (absent, ids, tied)], axis=0)
    heads = np.flatnonzero(new)
    lists = np.append(heads, len(ids))
    return pa.table({
        "doc_id": pa.array(ids[heads], pa.int64(), mask=absent[heads] > 0), "text_hash": pa.array(tied[heads], pa.int64()),
        "begin": _list(begin.astype(np.int32), lists, pa.int32()), "end": _list(end.astype(np.int32), lists, pa.int32()),
    })


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    head = np.ones(len(begin), dtype=bool)
    head[1:] = begin[1:] > reach[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(begin)) - 1 if len(heads) else heads
    return list(zip(begin[heads].tolist(), reach[tails].tolist(), strict=True))


BEGIN, END, KEYS = "__begin", "__end", ["__id", "__no_id", "__text_hash"]


def keyed(frame: DataFrame, text_hash: Column) -> DataFrame:
    """With columns that a document's rows are joined by; a null id is equal to a null id."""
    identity = F.col("doc_id").cast("long")
    return frame.withColumns({KEYS[0]: F.coalesce(identity, F.lit(0)), KEYS[1]: identity.isNull(), KEYS[2]: text_hash})


def spans(docs: DataFrame) -> DataFrame:
    """Every row with all its columns, and the runs of bytes that go as two lists, ``BEGIN`` and ``END``; runs may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    steps = Steps(spark)
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    # Texts equal in whole, but for the earliest.
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("text_hash"))
    rows = source.select(
        "doc_id", "text_hash", F.octet_length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"), key.alias("key")
    ).where(F.col("n") >= LENGTH)
    rows = steps.keep(rows, "rows")
    size = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    emitted = steps.keep(source.mapInArrow(lambda b: emit(b, buckets), EMITTED), "emitted")
    earliest = rows.groupBy("whole", "n").agg(F.min("key").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copies = steps.keep(
        rows.join(earliest, ["whole", "n"]).where("key <> least").select("doc_id", "text_hash", "n").distinct(), "copies"
    )
    found = emitted.where("bucket is not null").groupBy("bucket").applyInArrow(repeated, FOUND)
    found = steps.keep(found.groupBy("node").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("place", "before", "after"))), "found")
    nodes = emitted.where("bucket is null").select("chunk", F.posexplode(F.arrays_zip("doc_id", "text_hash"))).select(
        (F.shiftleft("chunk", 24) + F.col("pos")).alias("node"), F.col("col.doc_id"), F.col("col.text_hash")
    )

    first_of = nodes.groupBy("doc_id", "text_hash").agg(F.min("node").alias("node"))
    tied = F.col("text_hash")
    wanted = keyed(first_of, tied).join(keyed(copies, tied).select(*KEYS), KEYS, "left_anti")
    wanted = steps.keep(found.join(wanted.select("node", *KEYS), "node"), "wanted")
    steps.drop("emitted", "found", "rows")
    sent = keyed(source, tied).join(wanted.hint("shuffle_hash"), KEYS)
    sent = sent.select("doc_id", "text_hash", "text", "place", "before", "after").mapInArrow(lambda b: surroundings(b, buckets), SURROUNDINGS)
    resolved = steps.keep(sent.groupBy("bucket").applyInArrow(resolve, SPANS), "resolved")
    steps.drop("wanted")
    every = resolved.unionByName(
        copies.select("doc_id", "text_hash", F.array(F.lit(0)).alias("begin"), F.array(F.col("n").cast("int")).alias("end"))
    )
    every = keyed(every, tied).groupBy(*KEYS).agg(
        F.flatten(F.collect_list("begin")).alias(BEGIN), F.flatten(F.collect_list("end")).alias(END)
    )
    whole = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return keyed(docs, whole).join(every.hint("shuffle_hash"), KEYS, "left").drop(*KEYS)


def _runs(batch: pa.RecordBatch, row: int) -> list[tuple[int, int]]:
    begin = batch.column(BEGIN)[row].as_py()
    return merged(np.array(begin, np.int64), np.array(batch.column(END)[row].as_py(), np.int64)) if begin else []


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept."""

    def run(batches):
        for batch in batches:
            out = []
            for row, raw in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                runs = _runs(batch, row)
                kept = _kept(raw, runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    cut = spans(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), BEGIN, END)
    return cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows with their runs cut out of ``text`` and ``n_chars``, if there, counted anew. A row that loses bytes and has no word
    left goes; bytes of a code point cut in two are left out; a null text stays null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            out, keep = [], []
            for row, raw in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                runs = _runs(batch, row) if raw else []
                kept = _kept(raw, runs) if runs else raw
                out.append(None if kept is None else kept.decode("utf-8", "ignore"))
                keep.append(not runs or bool(kept.split()))
            columns = [batch.column(c) for c in names]
            columns[names.index("text")] = pa.array(out, pa.string())
            if "n_chars" in names:
                counted = pa.array([None if x is None else len(x) for x in out], pa.int64())
                columns[names.index("n_chars")] = counted.cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return spans(docs).select(*names, BEGIN, END).mapInArrow(run, docs.schema)
