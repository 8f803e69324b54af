"""Katz back-off scores with Good-Turing discounts, over bigrams, words and one class of unknown words.

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w was seen
               alpha(h) P(w)                otherwise;  P(w | h) = P(w) after a word never seen
    P(w)     = d1(c(w)) c(w) / N, and what the discounts leave goes to the unknown class

``alpha(h)`` is what the seen words leave, over what P(w) leaves of the unseen ones, so every distribution sums to one.
A context none of whose followers is discounted reserves one more count: c(h w) / (c(h) + 1).

Counts live in tables partitioned by hash. Texts are read once and kept as chunks: word hashes, each with its count, and
the sequence of words. Chunks and tables then talk in two rounds. A chunk asks each bucket for the counts of its distinct
words; with the answers it asks for its distinct pairs, saying how often each is in its training texts. A bucket adds up
what all chunks say, works out alpha and answers. So a pair crosses the network once per chunk, not once per token.

Scale: chunks are of ``CHUNK_BYTES`` of text, buckets as many as shuffle partitions. Pairs are dealt by context, and a
context with more than a bucket's share of all tokens is dealt by its next word to as many buckets as it has shares; the
sums for its alpha are at most two per bucket and pass through the driver. Words are known by a 64-bit hash: among 10^9
distinct words one collision is expected with odds of 1 in 40.

Defined results: a null or empty text is its end alone; rows without an id teach nothing and are scored; repeated rows
count once each; without training texts every token has probability 1 (one class of unknown words); other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps, fold, small_batches, texts
from sessionmill.llm.text import U64, joined, mix, pack, pack_rows, pack_sorted, slices, unpack, unpack_sorted, words

CHUNK_BYTES = 8 << 20
K = 5  # counts above it are not discounted
END, START = U64(0x5E5F454E445F5E01), U64(0x5E5F535441525402)

CHUNKS = (
    "chunk long, doc_id array<long>, learn array<boolean>, n_words array<int>, vocabulary binary, trained binary, tokens binary"
)
MESSAGES = "bucket int, chunk long, blobs array<binary>"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def good_turing(of_counts: list[int]) -> np.ndarray:
    """d(0..K): the share of a count that is kept, from how many things have count 1 .. K + 1.

    Katz's formula for the largest k up to K at which all shares lie in (0, 1]; without such a k nothing is discounted.
    """
    n = [0, *of_counts]
    for k in range(K, 0, -1):
        if not all(n[r] for r in range(1, k + 1)):
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (K - k)])
    return np.ones(K + 1)


class Unigrams:
    """P(w) from a count; 0 is the unknown class."""

    def __init__(self, total: int, of_counts: list[int]) -> None:
        self.total, self.keep = total, good_turing(of_counts)
        n = np.array([0, *of_counts[:K]], dtype=float)
        left = float(((1 - self.keep) * np.arange(K + 1) * n).sum())
        # Nothing discounted: one more count is reserved for the unknown class.
        self.scale, self.left = (1 / total, left / total) if left > 0 else (1 / (total + 1), 1 / (total + 1))

    def p(self, count: np.ndarray) -> np.ndarray:
        count = count.astype(np.float64)
        kept = np.where(count <= K, self.keep[np.minimum(count, K).astype(np.int64)], 1.0) * count * self.scale
        return np.where(count > 0, kept, self.left)


def encode(batches):
    """Texts to chunks of about ``CHUNK_BYTES``."""
    part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield _chunk((part << 32) + nth, held)
            nth, held, size = nth + 1, [], 0
    if held:
        yield _chunk((part << 32) + nth, held)


def _chunk(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    hashes, counts = [], []
    for batch in batches:
        w = words(*joined(batch.column("text")))
        hashes.append(w.hash)
        counts.append(w.counts)
    counts = np.concatenate(counts)
    ids = [x for b in batches for x in b.column("doc_id").to_pylist()]
    learn = np.array([bool(x) for b in batches for x in b.column("learn").to_pylist()])
    # The end of a text is a word like any other.
    every = np.empty(int(counts.sum()) + len(counts), dtype=U64)
    last = np.cumsum(counts + 1) - 1
    inner = np.ones(len(every), dtype=bool)
    inner[last] = False
    every[inner], every[last] = np.concatenate(hashes), END
    vocabulary, tokens = np.unique(every, return_inverse=True)
    trained = np.bincount(tokens, weights=np.repeat(learn, counts + 1), minlength=len(vocabulary)).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([learn.tolist()], pa.list_(pa.bool_())),
            pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([pack_sorted(vocabulary)], pa.binary()),
            pa.array([pack(trained)], pa.binary()), pa.array([pack(tokens.astype(np.uint32))], pa.binary()),
        ],
        ["chunk", "doc_id", "learn", "n_words", "vocabulary", "trained", "tokens"],
    )


def _messages(rows: list[tuple[int, int | None, list[bytes]]]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "chunk": pa.array([r[1] for r in rows], pa.int64()),
            "blobs": pa.array([r[2] for r in rows], pa.list_(pa.binary())),
        }
    )


def _bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that answers line up in the order of the questions."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def ask_words(batches, buckets: int):
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = batch.column("chunk")[row].as_py()
            vocabulary = unpack_sorted(batch.column("vocabulary")[row].as_py())
            trained = unpack(batch.column("trained")[row].as_py())
            at = _bounds(vocabulary, buckets)
            rows = [
                (b, chunk, [pack_sorted(vocabulary[i:j]), pack(trained[i:j])])
                for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i
            ]
            yield from _messages(rows).to_batches()


def count_words(table: pa.Table) -> pa.Table:
    """One bucket: its part of the word table (chunk null), its counts of counts (chunk -1), and an answer per chunk."""
    bucket = table.column("bucket")[0].as_py()
    asked = [(c.as_py(), [x.as_py() for x in b]) for c, b in zip(table.column("chunk"), table.column("blobs"), strict=True)]
    hashes = [unpack_sorted(b[0]) for _, b in asked]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpack(b[1]) for _, b in asked]), minlength=len(known)).astype(np.int64)
    seen = total > 0
    summary = np.concatenate([np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2], [total.sum(), seen.sum()]])
    rows = [(bucket, None, [pack_sorted(known[seen]), pack(total[seen])]), (bucket, -1, [pack(summary.astype(np.int64))])]
    end = np.cumsum([len(h) for h in hashes])
    for (chunk, _), h, stop in zip(asked, hashes, end, strict=True):
        rows.append((bucket, chunk, [pack(total[at[stop - len(h) : stop]])]))
    return _messages(rows)


class Chunk:
    """A chunk with the counts of its words: what its pairs are and which bucket each is asked of."""

    def __init__(self, row: dict, counts: list[tuple[int, bytes]], buckets: int, total: int, texts_learned: int) -> None:
        self.number, self.ids = row["chunk"], row["doc_id"]
        self.learn, self.n_words = np.array(row["learn"], dtype=bool), np.array(row["n_words"], dtype=np.int64)
        vocabulary = unpack_sorted(row["vocabulary"])
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.count = np.concatenate([unpack(blob) for _, blob in sorted(counts)])
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        n = len(vocabulary)
        context = np.concatenate([[n], self.tokens[:-1]])
        context[self.first] = n  # the start of a text is a context only
        hashes, count = np.append(vocabulary, START), np.append(self.count, texts_learned)
        # Only pairs of words that training texts hold can have been seen. For other words after a known one the pair
        # with the end is asked for, to learn the context's alpha.
        self.asks = np.flatnonzero(count[context] > 0)
        may = self.count[self.tokens[self.asks]] > 0
        end = int(self.tokens[self.first[-1] + self.n_words[-1]])
        second = np.where(may, self.tokens[self.asks], end)
        pairs, self.of = np.unique(context[self.asks] * (n + 1) + second, return_inverse=True)
        learned = np.repeat(self.learn, self.n_words + 1)[self.asks] & may
        trained = np.bincount(self.of, weights=learned, minlength=len(pairs))
        self.may = may
        self.h, self.w = pairs // (n + 1), pairs % (n + 1)
        shares = np.minimum(np.ceil(count[self.h] * (buckets / max(total, 1))), buckets).astype(np.int64)
        home = (mix(hashes[self.h] + U64(5)) % U64(buckets)).astype(np.int64)
        spread = (mix(hashes[self.w] + U64(7)) % np.maximum(shares, 1).astype(U64)).astype(np.int64)
        bucket = (home + spread) % buckets
        self.order = np.lexsort((hashes[self.w], hashes[self.h], bucket))
        self.bucket = bucket[self.order]
        self.trained = trained[self.order].astype(np.uint32)
        self.hashes, self.word_count, self.shares = hashes, count, shares

    def parts(self):
        """(bucket, from, to) of each run of ``order``."""
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield int(self.bucket[i]), int(i), int(j)

    def contexts(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """First pair and number of pairs of each context among pairs i to j."""
        h = self.h[self.order[i:j]]
        heads = np.flatnonzero(np.diff(h, prepend=-1))
        return heads, np.diff(heads, append=j - i)


def ask_pairs(chunk: Chunk) -> pa.Table:
    rows = []
    for bucket, i, j in chunk.parts():
        heads, sizes = chunk.contexts(i, j)
        chosen = chunk.order[i:j]
        h, w = chunk.h[chosen], chunk.w[chosen]
        local = np.unique(w)
        local = local[np.argsort(chunk.hashes[local])]
        place = np.empty(len(chunk.hashes), dtype=np.uint32)
        place[local] = np.arange(len(local), dtype=np.uint32)
        rows.append((bucket, chunk.number, [
            pack_sorted(chunk.hashes[h[heads]]), pack(sizes.astype(np.uint32)),
            pack((chunk.shares[chosen[heads]] > 1).astype(np.uint8)), pack_sorted(chunk.hashes[local]),
            pack(chunk.word_count[local].astype(np.uint64)), pack_rows(sizes, place[w]), pack(chunk.trained[i:j]),
        ]))
    return _messages(rows)


def count_pairs(table: pa.Table, unigrams: Unigrams) -> pa.Table:
    """One bucket as one row: its part of the pair table with the sums alpha needs, the same sums of contexts it has only
    part of, its counts of counts, and where each chunk's pairs are in the table."""
    bucket = table.column("bucket")[0].as_py()
    asked = [(c.as_py(), [unpack(x.as_py()) for x in b]) for c, b in zip(table.column("chunk"), table.column("blobs"), strict=True)]
    context, word, part, count, sizes = [], [], [], [], []
    word_hash = [np.cumsum(b[3], dtype=U64) for _, b in asked]
    words_known, word_at = np.unique(np.concatenate(word_hash), return_inverse=True)
    word_p = np.zeros(len(words_known))
    word_p[word_at] = unigrams.p(np.concatenate([b[4] for _, b in asked]))
    context_hash = [np.cumsum(b[0], dtype=U64) for _, b in asked]
    contexts_known, context_at = np.unique(np.concatenate(context_hash), return_inverse=True)
    split = np.zeros(len(contexts_known), dtype=bool)
    split[context_at] = np.concatenate([b[2] for _, b in asked]) > 0
    w0 = c0 = 0
    for (_, b), wh, ch in zip(asked, word_hash, context_hash, strict=True):
        n = b[1].astype(np.int64)
        gaps, some = b[5], n[n > 0]
        running = np.cumsum(gaps, dtype=gaps.dtype)
        heads = np.cumsum(some) - some
        places = running - np.repeat(running[heads] - gaps[heads], some)
        context.append(np.repeat(context_at[c0 : c0 + len(ch)], n))
        word.append(word_at[w0 : w0 + len(wh)][places])
        part.append(len(places))
        count.append(b[6])
        w0, c0 = w0 + len(wh), c0 + len(ch)
        sizes.append(n)
    code = np.concatenate(context) * np.int64(len(words_known)) + np.concatenate(word)
    pairs, at = np.unique(code, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(count), minlength=len(pairs)).astype(np.int64)
    of = pairs // len(words_known)
    seen = total > 0
    mass = np.zeros((len(contexts_known), K + 2))  # by count: 1 .. K, more; then P(w) of the words seen
    np.add.at(mass, (of[seen], np.minimum(total[seen], K + 1) - 1), total[seen])
    np.add.at(mass, (of[seen], K + 1), word_p[pairs[seen] % len(words_known)])
    summary = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].astype(np.int64)
    end = np.cumsum(part)
    places = [pack(at[stop - n : stop].astype(np.uint32)) for n, stop in zip(part, end, strict=True)]
    model = [
        pack_sorted(contexts_known), pack(split.astype(np.uint8)), mass.tobytes(), pack(of.astype(np.uint32)), pack(total),
        pack_sorted(words_known), pack((pairs % len(words_known)).astype(np.uint32)),
    ]
    return pa.table({
        "bucket": pa.array([bucket], pa.int32()),
        "of_counts": pa.array([summary.tolist()], pa.list_(pa.int64())),
        "split_hash": pa.array([contexts_known[split].view(np.int64).tolist()], pa.list_(pa.int64())),
        "split_mass": pa.array([mass[split].ravel().tolist()], pa.list_(pa.float64())),
        "model": pa.array([model], pa.list_(pa.binary())),
        "chunks": pa.array([[c for c, _ in asked]], pa.list_(pa.int64())),
        "places": pa.array([places], pa.list_(pa.binary())),
    })


def back_off(mass: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha, and the count that stands below a context's counts, from the sums of each context."""
    count = mass[:, : K + 1].sum(axis=1)
    left = (mass[:, :K] * (1 - keep[1:])).sum(axis=1)
    below = np.where(left > 0, count, count + 1)
    left = np.where(left > 0, left, 1.0)
    return left / np.maximum(below, 1) / np.maximum(1 - mass[:, K + 1], 1e-300), below


def answer_pairs(batches, keep: np.ndarray, split_hash: np.ndarray, split_mass: np.ndarray):
    """For each chunk the counts of its pairs, and for its contexts alpha and the count below."""
    for batch in batches:
        for row in range(batch.num_rows):
            bucket = batch.column("bucket")[row].as_py()
            model = [x.as_py() for x in batch.column("model")[row]]
            contexts, split = unpack_sorted(model[0]), unpack(model[1]) > 0
            mass = np.frombuffer(model[2], np.float64).reshape(-1, K + 2).copy()
            mass[split] = split_mass[np.searchsorted(split_hash, contexts[split])]
            alpha, below = back_off(mass, keep)
            log_alpha = np.log10(alpha)
            of, total = unpack(model[3]), unpack(model[4])
            for chunk, places in zip(batch.column("chunks")[row], batch.column("places")[row], strict=True):
                at = unpack(places.as_py())
                h = of[at]
                heads = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1))
                answer = [pack(total[at]), pack(below[h[heads]].astype(np.uint64)), log_alpha[h[heads]].tobytes()]
                yield from _messages([(bucket, chunk.as_py(), answer)]).to_batches()


def score_chunk(chunk: Chunk, answers: dict[int, list[bytes]], unigrams: Unigrams, keep: np.ndarray, distinct: int) -> pa.Table:
    n = len(chunk.h)
    count, below, log_alpha = np.zeros(n), np.ones(n), np.zeros(n)
    for bucket, i, j in chunk.parts():
        blobs = answers[bucket]
        _, sizes = chunk.contexts(i, j)
        chosen = chunk.order[i:j]
        count[chosen] = unpack(blobs[0])
        below[chosen] = np.repeat(unpack(blobs[1]).astype(np.float64), sizes)
        log_alpha[chosen] = np.repeat(np.frombuffer(blobs[2], np.float64), sizes)
    token_count = chunk.count[chunk.tokens]
    out = np.log10(unigrams.p(chunk.count))[chunk.tokens]
    with np.errstate(divide="ignore"):
        kept = np.where(count <= K, keep[np.minimum(count, K).astype(np.int64)], 1.0)
        direct = np.log10(kept * count / below)[chunk.of]
    seen = chunk.may & (count[chunk.of] > 0)
    out[chunk.asks] = np.where(seen, direct, out[chunk.asks] + log_alpha[chunk.of])
    base = np.log10((token_count + 1) / (unigrams.total + distinct + 1))
    return pa.table({
        "doc_id": pa.array(chunk.ids, pa.int64()),
        "n_tokens": pa.array(chunk.n_words + 1, pa.int64()),
        "n_known": pa.array(np.add.reduceat((token_count > 0).astype(np.int64), chunk.first), pa.int64()),
        "base_score": pa.array(np.add.reduceat(base, chunk.first)),
        "score": pa.array(np.add.reduceat(out, chunk.first)),
    })


PAIRS = (
    "bucket int, of_counts array<long>, split_hash array<long>, split_mass array<double>, model array<binary>,"
    " chunks array<long>, places array<binary>"
)


def score(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """Every document with its number of tokens and of known ones, and its log10 probability under both models."""
    spark = docs.sparkSession
    small_batches(spark)
    steps = Steps(spark)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a bucket is one group in memory
    source = texts(docs).withColumn(
        "learn", F.coalesce((F.lit(True) if learn is None else learn) & F.col("doc_id").isNotNull(), F.lit(False))
    )
    chunks = steps.keep_by(source.mapInArrow(encode, CHUNKS), "chunks", "chunk", buckets)
    counted = steps.keep(
        chunks.select("chunk", "vocabulary", "trained").mapInArrow(lambda b: ask_words(b, buckets), MESSAGES)
        .groupBy("bucket").applyInArrow(count_words, MESSAGES),
        "words",
    )
    summary = np.zeros(K + 3, np.int64)
    for row in counted.where("chunk = -1").toLocalIterator():  # a row a bucket, a few numbers each
        summary += unpack(bytes(row["blobs"][0]))
    of_counts, total, distinct = summary[: K + 1].tolist(), int(summary[K + 1]), int(summary[K + 2])
    learned = chunks.select(F.coalesce(F.sum(F.size(F.filter("learn", lambda x: x))), F.lit(0))).first()[0]
    unigrams = Unigrams(total, of_counts)

    def with_counts(table: pa.Table, answers: pa.Table) -> tuple[Chunk | None, dict]:
        if not table.num_rows:
            return None, {}
        rest, counts = {}, []
        for bucket, blobs in zip(answers.column("bucket").to_pylist(), answers.column("blobs").to_pylist(), strict=True):
            if len(blobs) == 1:
                counts.append((bucket, blobs[0]))
            else:
                rest[bucket] = blobs
        return Chunk(table.to_pylist()[0], counts, buckets, total, learned), rest

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, _ = with_counts(table, answers)
        return _messages([]) if chunk is None else ask_pairs(chunk)

    word_answers = counted.where("chunk >= 0")
    paired = steps.keep(
        chunks.groupBy("chunk").cogroup(word_answers.groupBy("chunk")).applyInArrow(ask, MESSAGES)
        .groupBy("bucket").applyInArrow(lambda t: count_pairs(t, unigrams), PAIRS),
        "pairs",
    )
    pair_counts, split = np.zeros(K + 1, np.int64), {}
    # A row a bucket; a context is split only if it has more than a bucket's share, so its parts are at most two a bucket.
    for row in paired.select("of_counts", "split_hash", "split_mass").toLocalIterator():
        pair_counts += np.array(row["of_counts"])
        for h, mass in zip(row["split_hash"], np.array(row["split_mass"]).reshape(-1, K + 2), strict=True):
            split[h] = split.get(h, 0.0) + mass
    keep = good_turing(pair_counts.tolist())
    split_hash = np.array(list(split), dtype=np.int64).view(U64)
    order = np.argsort(split_hash)
    split_hash, split_mass = split_hash[order], np.array(list(split.values())).reshape(-1, K + 2)[order]
    pair_answers = paired.select("bucket", "model", "chunks", "places").mapInArrow(
        lambda b: answer_pairs(b, keep, split_hash, split_mass), MESSAGES
    )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, rest = with_counts(table, answers)
        if chunk is None:
            return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        return score_chunk(chunk, rest, unigrams, keep, distinct)

    answers = word_answers.unionByName(pair_answers)
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def held_out_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores learned from the other folds."""
    out = score(docs, ~fold("doc_id", folds).isin(held, -1))
    return out.withColumn("held_out", fold("doc_id", folds) == held)
