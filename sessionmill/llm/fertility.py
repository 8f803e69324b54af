"""Quality rules on what public tokenizers make of a text.

Base rules count words, symbols, repeated lines and repeated runs of eight words. Texts that pass them are judged by tokenizer
fertility: characters per token of two public vocabularies, the share of tokens that fall back to bytes, and the entropy
of tokens relative to the largest that so many tokens can have. Each measure has a band per language (the ``lang`` column; where it
is null, the script most letters are of): quartiles over all texts that pass the base rules, widened by ``WIDEN`` times their
distance, at least by ``LEAST``, and by ``SLACK`` only where they are equal. A text outside a band is rejected.

A word is tokenized once per worker and batch of texts it is in; a cache of words is bounded by ``CACHE_WORDS``. Texts are read
once and not shuffled; only the narrow rows of measures are aggregated, by language, with sketches of the quartiles.

Defined results: null and empty texts have no words and fail; a band that cannot be formed (no text of that language passes)
rejects nothing; repeated rows count once each; a null lang is a group by script; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps, small_batches, texts
from sessionmill.llm.text import _SPACE, U64, Words, joined, mix, run_hash, slices, words
from sessionmill.operators.skew import join_facts

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
# The slack is about what the widening comes to on prose; differences below the least are not judged.
WIDEN, LEAST, SLACK = 2.0, 0.02, {"chars_per_token": 0.1, "chars_per_byte_token": 0.1, "fallback_share": 0.02, "entropy": 0.2}
CACHE_WORDS = 200_000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = (
    "doc_id long, grouping string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, entropy double"
)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(w: Words, size: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of ``size`` words found twice or more in it."""
    n, docs = len(w.hash), len(w.first) - 1
    if n < size:
        return np.zeros(docs, np.int64)
    acc = w.hash[: n - size + 1].copy()
    for j in range(1, size):
        acc = acc * U64(0x9E3779B97F4A7C15) + w.hash[j : n - size + 1 + j]
    at = np.flatnonzero(w.doc[: n - size + 1] == w.doc[size - 1 :])
    # The text's number is part of the window's hash.
    key = mix(acc[at] + mix(w.doc[at].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[at[twice]] += 1
    np.subtract.at(edge, at[twice] + size, 1)
    return per_text(np.cumsum(edge)[:-1] > 0, w.first)


def dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    start = start[start < n]
    start = start[data[start] != 10]
    # A line ends at the next line break or where its text ends.
    ends = np.union1d(breaks, offsets[1:])
    end = ends[np.searchsorted(ends, start, "right")]
    full = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    has = full[end] > full[start]
    start, end = start[has], end[has]
    doc = np.searchsorted(offsets, start, side="right") - 1
    h = mix(run_hash(data, start, end) + mix(doc.astype(U64) + U64(1)))
    _, first = np.unique(h, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[first], minlength=docs)


class Pieces:
    """Tokens of words under the two vocabularies, remembered by the word's hash."""

    def __init__(self, piece_file: str, byte_file: str, pattern: str, limit: int = CACHE_WORDS) -> None:
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        with open(byte_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size, self.limit = self.pieces.get_piece_size(), limit
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, U64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.fallback, self.byte_tokens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, w: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of each hash; ``at`` says where a word with that hash stands."""
        if len(self.known) + len(hashes) > self.limit:
            self.clear()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            of = [w.bytes_of(i).decode("utf-8", "replace") for i in at[new]]
            found = self.pieces.encode(of, num_threads=1)
            counts = np.array([len(x) for x in found], np.int64)
            ids = np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))
            ends = np.cumsum(counts)
            byte = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
            base = len(self.fallback)
            self.first = np.concatenate([self.first, self.first[-1] + ends])
            self.ids = np.concatenate([self.ids, ids])
            self.fallback = np.concatenate([self.fallback, byte[ends] - byte[ends - counts]])
            self.byte_tokens = np.concatenate([self.byte_tokens, [len(self.bytes.encode_ordinary(" " + x)) for x in of]])
            known = np.concatenate([self.known, hashes[new]])
            row = np.concatenate([self.row, np.arange(base, base + int(new.sum()))])
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
        return self.row[np.searchsorted(self.known, hashes)]


@lru_cache(maxsize=2)
def pieces(piece_file: str, byte_file: str, pattern: str) -> Pieces:
    return Pieces(piece_file, byte_file, pattern)


def fertility(p: Pieces, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte-fallback tokens, tokens of the byte vocabulary, entropy of tokens in bits."""
    docs = len(w.first) - 1
    if not len(w.hash):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs)
    types, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
    row = p.rows(w, types, first)
    pair, n = np.unique(w.doc * len(types) + of, return_counts=True)
    doc, kind = pair // len(types), row[pair % len(types)]
    size = p.first[kind + 1] - p.first[kind]
    n_tokens = np.bincount(doc, weights=size * n, minlength=docs).astype(np.int64)
    fallback = np.bincount(doc, weights=p.fallback[kind] * n, minlength=docs).astype(np.int64)
    byte_tokens = np.bincount(doc, weights=p.byte_tokens[kind] * n, minlength=docs).astype(np.int64)
    at = np.repeat(p.first[kind] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    code = np.repeat(doc * p.size, size) + p.ids[at]
    order = np.argsort(code)
    code, times = code[order], np.repeat(n, size)[order]
    head = np.flatnonzero(np.diff(code, prepend=-1))
    count = np.add.reduceat(times, head)
    of_doc = code[head] // p.size
    share = count / n_tokens[of_doc]
    return n_tokens, fallback, byte_tokens, np.bincount(of_doc, weights=-share * np.log2(share), minlength=docs)


# Scripts by the Unicode blocks that hold most of their letters: first and last code point.
SCRIPTS = {
    "latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF),
    "arabic": (0x600, 0x77F), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}


def script(text: str) -> str:
    """The script most letters are of; ``other`` without any, the first listed of equals."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = {name: int(((points >= a) & (points <= b)).sum()) for name, (a, b) in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return f"script:{best if counts[best] else 'other'}"


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def measures(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """The counts of the base rules and the measures of fertility, a row a text."""
    files = files or default_files()

    def run(batches):
        p = pieces(*files)
        for batch in slices(batches):
            data, offsets = joined(batch.column("text"))
            w = words(data, offsets, lower=False)
            starts = ((data & 0xC0) != 0x80) & ~_SPACE[data]
            chars = per_text(starts, offsets)
            n_tokens, fallback, byte_tokens, entropy = fertility(p, w)
            most = np.log2(np.maximum(np.minimum(n_tokens, p.size), 2))
            lang = batch.column("lang").to_pylist()
            grouping = [x if x is not None else script(t) for x, t in zip(lang, batch.column("text").to_pylist(), strict=True)] if None in lang else lang
            tokens = np.maximum(n_tokens, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(grouping, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(chars),
                 pa.array(per_text(_SYMBOL[data], offsets)), pa.array(dup_lines(data, offsets).astype(np.int64)), pa.array(repeat_words(w)),
                 pa.array(n_tokens), pa.array(chars / tokens), pa.array(chars / np.maximum(byte_tokens, 1)), pa.array(fallback / tokens),
                 pa.array(entropy / most)],
                ["doc_id", "grouping", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens",
                 "chars_per_token", "chars_per_byte_token", "fallback_share", "entropy"],
            )

    small_batches(docs.sparkSession)
    source = texts(docs, "lang").withColumn("lang", F.col("lang").cast("string"))
    return source.mapInArrow(run, MEASURES).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )


def bands(measured: DataFrame) -> DataFrame:
    """Per group the two ends of each measure's band."""
    ends = []
    for name, slack in SLACK.items():
        q = F.percentile_approx(name, [0.25, 0.75], 1000)
        room = F.when(q[1] > q[0], F.greatest(F.lit(LEAST), WIDEN * (q[1] - q[0]))).otherwise(F.lit(slack))
        ends += [(q[0] - room).alias(f"{name}_low"), (q[1] + room).alias(f"{name}_high")]
    return measured.where(~F.col("base_failed")).groupBy("grouping").agg(*ends)


def judged(docs: DataFrame) -> DataFrame:
    """Every text with its counts, its measures and the verdict."""
    measured = Steps(docs.sparkSession).keep(measures(docs), "measures")
    out = join_facts(measured, bands(measured), ["grouping"])  # a language may have most of the rows
    inside = F.lit(True)
    for name in SLACK:
        inside &= F.coalesce(F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)
