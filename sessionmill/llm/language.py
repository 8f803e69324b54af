"""Language by error-correcting output codes over byte n-grams.

Every language has a codeword. One binary logistic classifier per bit, over hashed byte bigrams and trigrams of the whole
text, predicts that bit; the language whose codeword has the smallest loss over all bits wins, weighted by the margins,
and a text whose second-best codeword is nearly as close is flagged as ambiguous.

Fitting uses a bounded sample of rows (``SAMPLE`` in expectation, dealt evenly over the languages, so a rare one is kept
whole) chosen by a hash of the id. A sampled text becomes its n-gram counts, of a fixed size, where it is read; these meet in one
task, which fits, and the driver gets the model alone. Predicting reads every whole text and shuffles nothing.

Defined results: a null text or one without a letter is ``und`` with score 0; with one learned language it always wins
with score 1, with none every text is ``und``; ties go to the language first by name; rows with a null language or id
teach nothing; repeated rows are predicted once each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import fold, small_batches, texts
from sessionmill.llm.text import _LOWER, SLICE_BYTES, joined, pack, slices, unpack

SAMPLE = 1_600
PAIRS, TRIPLES = 1 << 12, 1 << 13
EPOCHS = 150
AMBIGUOUS = 0.5
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean, bit_errors int"
LETTER = r"\p{L}"


@dataclass
class Codes:
    """``words``: +1 or -1, a row a language; ``pairs`` and ``triples``: weights, a row a bit."""

    languages: list[str]
    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    bias: np.ndarray


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """Codewords as far apart as the best of a few hundred random draws; all splits where these are few."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1.0 if i == 0 or (s >> (i - 1)) & 1 == 0 else -1.0 for s in splits] for i in range(n)])
    bits, rng, best, apart = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if np.abs(code.sum(axis=0)).max() == n:
            continue
        near = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if near > apart:
            best, apart = code, near
    return best


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the bigram and trigram that begin at each byte but the last ones."""
    low = _LOWER[data].astype(np.uint32)
    two = (low[:-1] << np.uint32(8)) | low[1:]
    three = (two[:-1] << np.uint32(8)) | low[2:]
    return (
        ((two * np.uint32(2654435769)) >> np.uint32(20)).astype(np.int32),
        ((three * np.uint32(2246822519)) >> np.uint32(19)).astype(np.int32),
    )


def sums(values: np.ndarray, offsets: np.ndarray, short: int) -> np.ndarray:
    """Per text, the sum over the windows that begin in it and end in it; a window is ``short + 1`` bytes."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    begin = np.minimum(offsets[:-1], len(values))
    end = np.minimum(np.maximum(offsets[1:] - short, begin), len(values))
    return total[end] - total[begin]


def margins(codes: Codes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text, one column a bit."""
    two, three = grams(data) if len(data) > 2 else (np.zeros(0, np.int32),) * 2
    n = np.diff(offsets)
    count = np.maximum(np.maximum(n - 1, 0) + np.maximum(n - 2, 0), 1)
    out = np.empty((len(n), len(codes.bias)))
    for bit in range(len(codes.bias)):
        out[:, bit] = sums(codes.pairs[bit][two], offsets, 1) + sums(codes.triples[bit][three], offsets, 2)
    return out / count[:, None] + codes.bias


def counted(data: np.ndarray, step: int = SLICE_BYTES) -> np.ndarray:
    """How often each slot is in a text, which is looked at in pieces."""
    row = np.zeros(PAIRS + TRIPLES, np.int64)
    if len(data) > 2:
        for begin in range(0, len(data), step):
            two, three = grams(data[begin : begin + step + 2])
            row[:PAIRS] += np.bincount(two[:step], minlength=PAIRS)
            row[PAIRS:] += np.bincount(three[:step], minlength=TRIPLES)
    return row


def frequencies(of: list[bytes]) -> np.ndarray:
    """Shares of the slots, from packed counts; a row a text."""
    rows = np.zeros((len(of), PAIRS + TRIPLES), dtype=np.float32)
    for i, packed in enumerate(of):
        n = unpack(packed)
        rows[i] = n / max(n.sum(), 1)
    return rows


def fit(sample: list[tuple[bytes, str, bytes]], epochs: int = EPOCHS) -> Codes:
    """The model of a bounded list of (digest of a text, language, packed counts): all bits at once, by gradient descent with momentum."""
    sample = sorted(set(sample))
    languages = sorted({x for _, x, _ in sample})
    words = codewords(len(languages))
    bits = words.shape[1]
    if len(languages) < 2:
        return Codes(languages, words, np.zeros((0, PAIRS)), np.zeros((0, TRIPLES)), np.zeros(0))
    x = frequencies([n for _, _, n in sample])
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    number = np.array([languages.index(l) for _, l, _ in sample])
    y = words[number].astype(np.float32)
    share = 1 / np.bincount(number)[number].astype(np.float32)  # every language counts the same
    share /= share.sum()
    weight, bias = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    speed, bias_speed = np.zeros_like(weight), np.zeros_like(bias)
    rate = 4.0 / float(np.mean((x**2).sum(axis=1)))
    for _ in range(epochs):
        margin = np.clip(y * (x @ weight + bias), -30, 30)
        slope = (share[:, None] * y) / (1 + np.exp(margin))
        speed = 0.9 * speed + rate * (x.T @ slope - 1e-4 * weight)
        bias_speed = 0.9 * bias_speed + 0.5 * slope.sum(axis=0)
        weight += speed
        bias += bias_speed
    weight = (weight * scale[:, None]).T.astype(np.float64)
    return Codes(languages, words, weight[:, :PAIRS].copy(), weight[:, PAIRS:].copy(), bias.astype(np.float64))


def decode(codes: Codes, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its share of the likelihood, whether another codeword is nearly as close, wrong bits of the winner."""
    n = len(codes.languages)
    if n < 2:
        return (np.zeros(len(margin), int), np.full(len(margin), float(n)), np.zeros(len(margin), bool), np.zeros(len(margin), int))
    # A bit's loss is -log of the probability that its classifier gives to the codeword's bit.
    loss = np.logaddexp(0, -margin[:, None, :] * codes.words[None, :, :]).sum(axis=2)
    winner = loss.argmin(axis=1)
    least = loss[np.arange(len(loss)), winner]
    score = 1 / np.exp(np.clip(least[:, None] - loss, -500, 0)).sum(axis=1)
    second = np.partition(loss, 1, axis=1)[:, 1]
    wrong = (np.sign(margin) != codes.words[winner]).sum(axis=1)
    return winner, score, second - least < AMBIGUOUS, wrong


def training_sample(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """About ``SAMPLE`` rows (digest of the text, lang, packed counts), evenly over languages, by a hash of the id."""
    usable = texts(docs, "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    usable = usable.withColumn("lang", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(SAMPLE // max(len(sizes), 1), 1)
    known = [F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, each / n))] or [F.lit(""), F.lit(0.0)]
    share = F.element_at(F.create_map(*known), F.col("lang"))
    rows = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches):
        for batch in slices(batches):
            data, offsets = joined(batch.column("text"))
            of = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in of], pa.binary()), batch.column("lang"),
                 pa.array([pack(counted(x)) for x in of], pa.binary())],
                ["digest", "lang", "counts"],
            )

    return rows.where(F.col("text").rlike(LETTER)).select("text", "lang").mapInArrow(run, "digest binary, lang string, counts binary")


def fit_frame(sample: DataFrame) -> Codes:
    """The model of a bounded sample, fitted in one task."""

    def run(batches):
        rows = [(r["digest"], r["lang"], r["counts"]) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else fit([])


def identify(codes: Codes, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Language number (-1: none), share, ambiguity and wrong bits of each text."""
    winner, score, unsure, wrong = decode(codes, margins(codes, *joined(column)))
    none = ~np.asarray(pc.match_substring_regex(column.fill_null(""), LETTER).to_numpy(zero_copy_only=False), bool)
    if not codes.languages:
        none[:] = True
    winner[none], score[none], unsure[none], wrong[none] = -1, 0.0, False, 0
    return winner, score, unsure, wrong


def kept(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose language is known and not ambiguous; learned from all rows with a language."""
    spark = docs.sparkSession
    small_batches(spark)
    codes = spark.sparkContext.broadcast(fit_frame(training_sample(docs)))

    def run(batches):
        for batch in slices(batches):
            winner, _, unsure, _ = identify(codes.value, batch.column("text"))
            yield batch.filter(pa.array((winner >= 0) & ~unsure))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """Every document with its language, the winner's share, the ambiguity flag and the number of wrong bits."""
    spark = docs.sparkSession
    small_batches(spark)
    codes = spark.sparkContext.broadcast(fit_frame(training_sample(docs, learn)))

    def run(batches):
        names = np.array([*codes.value.languages, "und"], dtype=object)
        for batch in slices(batches):
            winner, score, unsure, wrong = identify(codes.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[winner], pa.string()), pa.array(score), pa.array(unsure), pa.array(wrong.astype(np.int32))],
                ["doc_id", "lang_pred", "score", "ambiguous", "bit_errors"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def held_out_predictions(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predictions learned from the other folds."""
    out = predict(docs, ~fold("doc_id", folds).isin(held, -1))
    return out.withColumn("held_out", fold("doc_id", folds) == held)
