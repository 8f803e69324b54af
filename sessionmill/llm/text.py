"""Whole texts as arrays: what the operators share inside a task.

Texts of a batch stay one byte buffer with offsets, and words, shingles and byte windows are found by array
operations over it. Nothing here knows of Spark but the column it is handed.

A word is a maximal run of bytes other than space and U+0009 to U+000D, lower-cased in A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
# An odd base has an inverse modulo 2^64, so a run's hash is a difference of prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), dtype=U64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(pow(base, have, 1 << 64))
        have += take
    return out


class _Powers:
    """Powers of the base, kept between batches and grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, powers(base, 1 << 16)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            table = powers(self.base, n)
            if n > 8 * SLICE_BYTES:
                return table
            self.table = table
        return self.table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which every bit depends on all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n+1 offsets; a null text is empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    if not len(binary):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = binary.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = joined(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """Words in the order of the texts; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    n, docs = len(data), len(offsets) - 1
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    at = offsets[:-1][offsets[:-1] < n]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    cut[n] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    if n:
        ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(data, start, end, doc, first, run_hash(data, start, end))


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands."""
    n = len(data)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _UP.upto(n), out=total[1:])
    return mix((total[end] - total[start]) * _DOWN.upto(n + 1)[start])


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of ``k`` bytes, not mixed; n - k + 1 of them."""
    n = len(data)
    if n < k:
        return np.zeros(0, dtype=U64)
    # Doubling, as in exponentiation: windows of width w and of width 2w from those at w's distance.
    out, width, bits = None, 0, bin(k)[2:]
    unit = _BYTE[data]
    for bit in bits:
        if width:
            scale = U64(pow(_BASE, width, 1 << 64))
            m = n - 2 * width + 1
            out = out[:m] + out[width : width + m] * scale
            width *= 2
        if bit == "1":
            scale = U64(pow(_BASE, width, 1 << 64))
            out = unit.copy() if not width else out[: n - width] + unit[width:] * scale
            width += 1
    return out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words and the text each is of, in order; a text with fewer words but one gives its whole sequence."""
    counts, n = w.counts, len(w.hash)
    long = counts >= k
    out_hash, out_doc = [], []
    if n >= k:
        acc = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * U64(_BASE) + w.hash[j : n - k + 1 + j]
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        out_hash.append(mix(acc[ok] ^ U64(k)))
        out_doc.append(w.doc[: n - k + 1][ok])
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        whole = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = counts[short] > j
            whole[has] = whole[has] * U64(_BASE) + w.hash[w.first[short[has]] + j]
        out_hash.append(mix(whole ^ (counts[short].astype(U64) + U64(1 << 32))))
        out_doc.append(short)
    if not out_hash:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = np.concatenate(out_doc)
    order = np.argsort(doc, kind="stable") if len(out_doc) > 1 else slice(None)
    return np.concatenate(out_hash)[order], doc[order]


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: leading zero bytes cost nothing."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    head = values.dtype.str[1:].encode() + b":" + str(len(values)).encode() + b";"
    return head + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    head, _, body = blob.partition(b";")
    kind, _, n = head.partition(b":")
    dtype, n = np.dtype(kind.decode()), int(n)
    raw = np.frombuffer(_CODEC.decompress(body, n * dtype.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    gaps = unpack(blob)
    return np.cumsum(gaps, dtype=gaps.dtype)


def pack_rows(counts: np.ndarray, values: np.ndarray) -> bytes:
    """Lists of integers, ``counts`` long each, ascending in each: differences with a fresh start per list."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    at = np.cumsum(counts)[:-1] if len(counts) else counts
    heads = np.concatenate([[0], at]).astype(np.int64)[: len(counts)][counts > 0]
    gaps[heads] = values[heads]
    return pack(gaps)


def unpack_rows(counts: np.ndarray, blob: bytes) -> np.ndarray:
    gaps = unpack(blob)
    if not len(gaps):
        return gaps
    total = np.cumsum(gaps, dtype=gaps.dtype)
    some = counts[counts > 0]
    heads = np.cumsum(some) - some
    return total - np.repeat(total[heads] - gaps[heads], some)
