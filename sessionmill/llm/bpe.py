"""BPE encoding and decoding with a public vocabulary file.

Encoding of one word keeps its symbols as a doubly linked list and the mergeable pairs in a priority queue of (rank,
position). The lowest rank is merged first, the leftmost of equals; an entry whose pair has changed since it was queued
is stale and skipped. A word of n symbols takes O(n log n), so a run of letters as long as the text is no hazard.
Decoding joins vocabulary strings.

Words are encoded where their text is read: no shuffle, no state but a vocabulary (a file of fixed size) and a cache of
words already encoded, bounded by ``CACHE_WORDS``. A cache of two generations keeps the frequent words.

Defined results: null and empty texts have no tokens; repeated rows are encoded once each; a null doc_id stays null;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sessionmill.llm.frames import small_batches, texts
from sessionmill.llm.text import slices

CACHE_WORDS = 250_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Cache(dict):
    """Results of ``make`` by word: at most twice ``limit`` of them, the ones in use kept. Long words are made anew."""

    def __init__(self, make: Callable[[str], Any], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class WordBpe:
    """A tokenizer file of the kind: NFC, white space folded, lower case, words cut by a pattern, BPE with word ends."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        # A pair of ids -> (rank, id of the merged symbol)
        self.merges = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in symbols]
        self.last = [self.ids.get(s + self.suffix) for s in symbols]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.cuts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.words = Cache(self.word, cache_words)

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter: a final sigma is no special case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers, and their strings."""
        ids = self.encode_word(word)
        return array("I", ids).tobytes(), " ".join([self.strings[i] for i in ids])

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get((symbols[i], symbols[j]))
            if not found or found[0] != rank:  # stale: one side was merged meanwhile
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def _runs(self, text: str) -> Iterator[tuple[list[str] | None, int]]:
        """Words between special tokens, and the special tokens' ids."""
        begin = 0
        for m in self.cuts.finditer(text) if "<|" in text else ():
            yield self.pieces(self.normalise(text[begin : m.start()])), -1
            yield None, self.special[m.group()]
            begin = m.end()
        yield self.pieces(self.normalise(text[begin:] if begin else text)), -1

    def encode(self, text: str) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw)) if (raw := self.encode_decode(text)[0]) else []

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a space between them, special ones too."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text that decoding them gives."""
        ids, strings = [], []
        for words, number in self._runs(text):
            if words is None:
                ids.append(struct.pack("<I", number))
                strings.append(self.strings[number])
            else:
                found = list(map(self.words.__getitem__, words))
                ids += [x for x, _ in found]
                strings += [x for _, x in found if x]
        return b"".join(ids), " ".join(strings)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_frame(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every whole text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            rows = [t.encode_decode(x) for x in batch.column("text").to_pylist()]
            ids = [struct.unpack(f"<{len(raw) // 4}I", raw) for raw, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_frame(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give an empty text, ids outside the vocabulary are left out."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            out = [t.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, and as ``digests`` their number and the digests of ids and decoded text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in slices(batches):
            raws, of_text = [], []
            for text in batch.column("text").to_pylist():
                raw, decoded = t.encode_decode(text)
                raws.append(raw)
                of_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            counts = np.array([len(raw) // 4 for raw in raws], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raws), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(counts), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token count and digests of ids and of the decoded text, without moving either out of the task."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                ids, decoded = t.encode_decode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, SCHEMA)
