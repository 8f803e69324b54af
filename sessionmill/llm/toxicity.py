"""Toxic spans by a linear-chain conditional random field.

Labels say only which documents are toxic. Tokens are labelled from them: a word, prefix or suffix that is found in far
more toxic than other documents marks its tokens in toxic documents. A two-state chain over the tokens of a sentence is
then fitted to these labels by its exact gradient (forward-backward), and a document's score is a logistic function of
the expected number of toxic tokens, the largest marginal, the length and the rate. Fitting uses a bounded sample of labelled rows
(``SAMPLE_TOXIC``, ``SAMPLE_OTHER``, in expectation, of texts up to ``SAMPLE_CHARS``); scoring reads every whole text
and shuffles nothing.

A chain ends at a word that ends in one of ``.!?`` or after ``CHAIN`` words, so its length is bounded.

Defined results: null and empty texts score as a text of no words; repeated label rows count as one, the largest label
winning; rows without a label or an id teach nothing; without labels of both kinds every score is the share of toxic
labels (0 if there are none); other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import fold, small_batches, texts
from sessionmill.llm.text import U64, Words, joined, mix, run_hash, slices, words

SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_CHARS = 1_500, 3_000, 20_000
BITS = 17
CHAIN = 128
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8), (4, 5)
MARK_RATIO, MARK_SHARE, MARK_LEAST = 12.0, 0.008, 4
EPOCHS = 30
SCHEMA = (
    "doc_id long, score double, predicted int, expected double, n_words long,"
    " spans array<struct<begin:long,end:long>>"
)


@dataclass
class Crf:
    """Weights of state 1 against state 0, and the four transition scores as factors."""

    emission: np.ndarray
    bias: float
    move: np.ndarray
    calibration: np.ndarray
    centre: np.ndarray
    prior: float


def word_features(w: Words, at: np.ndarray) -> np.ndarray:
    """Hashed features of the words numbered ``at``: the word, its first and its last bytes; one row a word."""
    start, end = w.start[at], w.end[at]
    hashes = [w.hash[at]]
    for k in PREFIXES:
        hashes.append(run_hash(w.data, start, np.minimum(end, start + k)) + U64(k))
    for k in SUFFIXES:
        hashes.append(run_hash(w.data, np.maximum(start, end - k), end) + U64(100 + k))
    return np.stack([mix(h) for h in hashes], axis=1)


def slots(features: np.ndarray) -> np.ndarray:
    return (features >> U64(64 - BITS)).astype(np.int64)


def chains(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, longest first."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8))
    head = np.ones(n, dtype=bool)
    head[1:] = stop[:-1] | (w.doc[1:] != w.doc[:-1])
    begin = np.flatnonzero(head)
    length = np.diff(begin, append=n)
    pieces = -(-length // CHAIN)
    if pieces.max() > 1:
        which = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = begin[which] + nth * CHAIN, np.minimum(CHAIN, length[which] - nth * CHAIN)
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def marginals(
    emission: np.ndarray, move: np.ndarray, begin: np.ndarray, length: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every word; with ``pairs`` also the expected number of each transition.

    Only ratios of state 1 to state 0 are carried, so nothing under- or overflows however long a chain is.
    """
    factor = np.exp(np.clip(emission, -30, 30))
    ahead, behind = np.empty_like(factor), np.ones_like(factor)
    expected = np.zeros((2, 2))
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    (m00, m01), (m10, m11) = move
    for t in range(steps):
        at = begin[: active[t]] + t
        if t:
            last = ahead[at - 1]
            ahead[at] = factor[at] * (m01 + m11 * last) / (m00 + m10 * last)
        else:
            ahead[at] = factor[at]
    for t in range(steps - 1, 0, -1):
        at = begin[: active[t]] + t
        weight = factor[at] * behind[at]
        behind[at - 1] = (m10 + m11 * weight) / (m00 + m01 * weight)
        if pairs:
            last = ahead[at - 1]
            parts = [np.full(len(at), m00), m01 * weight, m10 * last, m11 * last * weight]
            total = sum(parts)
            expected += np.array([(p / total).sum() for p in parts]).reshape(2, 2)
    odds = ahead * behind
    return odds / (1 + odds), expected


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def document_inputs(p: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns for the logistic function of documents with ``n`` words, and their expected numbers of toxic words."""
    docs = len(n)
    expected = np.bincount(doc, weights=p, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, doc, p)
    rate = expected / (n + 20)  # a long text has words that look like a mark by chance
    columns = [np.ones(docs), np.log1p(expected), np.log1p(np.maximum(expected - 1, 0)), top, np.log1p(n), np.log1p(100 * rate), np.log1p(1000 * rate)]
    return np.stack(columns, axis=1), expected


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> Crf:
    """The model of a bounded list of (text, toxic)."""
    sample = sorted(set(sample))  # a text copied many times would make all its words marks
    y = np.array([t for _, t in sample], dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    nothing = Crf(np.zeros(1 << BITS), 0.0, np.ones((2, 2)), np.zeros(7), np.zeros(7), prior)
    if not 0 < prior < 1:
        return nothing
    texts_of = pa.RecordBatch.from_arrays([pa.array([t for t, _ in sample], pa.string())], ["text"])
    hashes, docs, counts, kinds, features, begins, lengths, at, base = [], [], [], [], [], [], [], 0, 0
    for batch in slices(iter([texts_of])):
        w = words(*joined(batch.column("text")))
        found, first = np.unique(w.hash, return_index=True)
        kinds.append(found)
        features.append(word_features(w, first))
        begin, length = chains(w)
        begins.append(begin + at)
        lengths.append(length)
        hashes.append(w.hash)
        docs.append(w.doc + base)
        counts.append(w.counts)
        at, base = at + len(w.hash), base + batch.num_rows
    word_doc, n_words = np.concatenate(docs), np.concatenate(counts)
    types, of = np.unique(np.concatenate(hashes), return_inverse=True)
    if not len(types):
        return nothing
    features = np.concatenate(features)[np.unique(np.concatenate(kinds), return_index=True)[1]]
    begin, length = np.concatenate(begins), np.concatenate(lengths)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    del hashes, docs, counts, kinds, begins, lengths, texts_of
    # In how many toxic and other documents is each feature? One kind of feature after the other, to hold little at once.
    n1, n0 = y.sum(), (1 - y).sum()
    marked = np.zeros(len(types), dtype=bool)
    pair = np.unique(word_doc * len(types) + of)
    doc, kind = pair // len(types), pair % len(types)
    for column in features.T:
        known, number = np.unique(column, return_inverse=True)
        seen = np.unique(doc * len(known) + number[kind])
        toxic = np.bincount(seen % len(known), weights=y[seen // len(known)], minlength=len(known))
        other = np.bincount(seen % len(known), minlength=len(known)) - toxic
        marks = (toxic >= max(MARK_LEAST, MARK_SHARE * n1)) & (
            (toxic + 0.5) / (n1 + 1) >= MARK_RATIO * (other + 0.5) / (n0 + 1)
        )
        marked |= marks[number]
    del pair, doc, kind
    label = marked[of] & (y[word_doc] > 0)
    head = np.zeros(len(of), dtype=bool)
    head[begin] = True
    inner = ~head
    move_seen = np.array([[np.sum(inner[1:] & (label[:-1] == a) & (label[1:] == b)) for b in (0, 1)] for a in (0, 1)], float)
    slot = slots(features).astype(np.int32)
    del features
    weight, bias, move = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    squares, bias_squares, move_squares = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):
        emission = sum(weight[column] for column in slot.T) + bias
        p, pairs = marginals(emission[of], np.exp(move), begin, length, pairs=True)
        gap = np.bincount(of, weights=label - p, minlength=len(types))
        slope = np.zeros_like(weight)
        for column in range(slot.shape[1]):
            slope += np.bincount(slot[:, column], weights=gap, minlength=len(slope))
        slope -= 0.05 * weight
        squares += slope**2
        weight += 0.5 * slope / np.sqrt(squares)
        slope = gap.sum()
        bias_squares += slope**2
        bias += 0.5 * slope / np.sqrt(bias_squares)
        slope = move_seen - pairs - 0.05 * move
        move_squares += slope**2
        move += 0.2 * slope / np.sqrt(move_squares)
    emission = sum(weight[column] for column in slot.T) + bias
    p, _ = marginals(emission[of], np.exp(move), begin, length)
    x, _ = document_inputs(p, word_doc, n_words)
    centre = x.mean(axis=0) * np.array([0.0] + [1.0] * 6)
    return Crf(weight, bias, np.exp(move), _logistic(x - centre, y), centre, prior)


def tag(model: Crf, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of every word, score and expected count of every document."""
    if len(w.hash):
        _, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
        emission = model.emission[slots(word_features(w, first))].sum(axis=1) + model.bias
        p, _ = marginals(emission[of], model.move, *chains(w))
    else:
        p = np.zeros(0)
    x, expected = document_inputs(p, w.doc, w.counts)
    if model.calibration.any():
        score = 1 / (1 + np.exp(-np.clip((x - model.centre) @ model.calibration, -30, 30)))
    else:
        score = np.full(len(x), model.prior)
    return p, score, expected


def spans(p: np.ndarray, w: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last code point (exclusive) of each run of words with a marginal of 0.5 or more."""
    hit = p >= 0.5
    head, tail = hit.copy(), hit.copy()
    if len(hit):
        same = w.doc[1:] == w.doc[:-1]
        head[1:] &= ~(hit[:-1] & same)
        tail[:-1] &= ~(hit[1:] & same)
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    doc = w.doc[first]
    base = points[offsets[doc]]
    return doc, points[w.start[first]] - base, points[w.end[last]] - base


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """A bounded sample of labelled (text, toxic) rows for which ``learn`` holds, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TOXIC / max(sizes.get(1, 0), 1))).otherwise(
        min(1.0, SAMPLE_OTHER / max(sizes.get(0, 0), 1))
    )
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))
    return (
        texts(docs)
        .where((F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0))
        .join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_OTHER ids are expected
        .select("text", "toxic")
    )


def fit_frame(sample: DataFrame) -> Crf:
    """The model of a bounded sample, fitted in one task."""

    def run(batches):
        rows = [(r["text"], r["toxic"]) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else fit([])


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """Every document with its score, the expected number of toxic words, and the spans that offend."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit_frame(training_sample(docs, labels, learn)))

    def run(batches):
        for batch in slices(batches):
            data, offsets = joined(batch.column("text"))
            w = words(data, offsets)
            p, scores, expected = tag(model.value, w)
            doc, begin, end = spans(p, w, offsets)
            lists = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(expected),
                 pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), found)],
                ["doc_id", "score", "predicted", "expected", "n_words", "spans"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores learned from the other folds."""
    scored = score(docs, labels, ~fold("doc_id", folds).isin(held, -1))
    return scored.withColumn("held_out", fold("doc_id", folds) == held)
