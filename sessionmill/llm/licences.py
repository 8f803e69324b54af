"""Licence families of paragraphs.

A multinomial logistic regression over hashed word unigrams, bigrams and trigrams tells licence families and, as a class of its own,
everything else. It is trained on variants of short templates (words dropped, changed, put in front) against paragraphs of
a bounded sample of texts (``SAMPLE``), and its temperature is fitted on variants held back, so probabilities mean what they
say. A paragraph is of a family if its probability is ``SURE`` or more, and confirmed if it holds enough of the word trigrams of
one of the family's templates. Paragraphs are lines, and so that wrapped notices are seen whole, also the groups of neighbouring lines,
of any number and without a blank one, over which the trigrams of a template are spread; each line of a confirmed group counts as
licensed. Words without a letter or digit, as comment marks, are left out of groups. Every whole text is read once; nothing is shuffled.

Defined results: null and empty texts have no paragraphs; repeated rows are judged once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.decontaminate import plain
from sessionmill.llm.frames import small_batches, texts
from sessionmill.llm.text import U64, Words, joined, mix, slices, words

SAMPLE, SAMPLE_CHARS = 400, 20_000
BITS, EPOCHS, VARIANTS = 16, 60, 60
SURE, CONFIRM = 0.5, 0.6
MAYBE = 0.5  # of a template's trigrams, and a group of lines is looked at
# Letters and digits, and whatever is not ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCHEMA = (
    "doc_id long, n_paragraphs long, n_licensed long, n_unconfirmed long, family string, probability double, families array<string>"
)

# Wording of public licence notices, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License.",
        "Released under the MIT license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved.",
    ],
}


@dataclass
class Model:
    """``weights``: a row a feature slot, a column a class; the last class is everything else."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def lines(data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line each word is in, counted over all texts of the batch: of lines with words, and of all lines."""
    marks = np.zeros(len(data) + 1, np.int64)
    marks[1:][data == 10] = 1
    np.add.at(marks, offsets[:-1], 1)
    every = np.cumsum(marks)[w.start]
    _, line = np.unique(every, return_inverse=True)
    return line, every


def features(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words, word pairs and triples of each line, and the line each is of."""
    shift = U64(64 - BITS)
    found, of = [(mix(h) >> shift).astype(np.int32)], [line]
    acc = h
    for size in (2, 3):
        acc = acc[: len(h) - size + 1] * U64(0x9E3779B97F4A7C15) + h[size - 1 :] if len(h) >= size else acc[:0]
        ok = line[: len(acc)] == line[size - 1 :] if len(acc) else np.zeros(0, bool)
        found.append((mix(acc[ok] + U64(size)) >> shift).astype(np.int32))
        of.append(line[: len(acc)][ok])
    return np.concatenate(found), np.concatenate(of)


def scores(model: Model, slot: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Class scores of each line: weights summed over its features, over the root of their number."""
    order = np.argsort(of, kind="stable")
    slot, of = slot[order], of[order]
    total = np.empty((n, len(model.bias)))
    step = 1 << 17
    head = np.searchsorted(of, np.arange(n + 1))
    begin = 0
    while begin < n:  # some lines at a time: the gathered weights are wide
        end = max(int(np.searchsorted(head, head[begin] + step, "right")) - 1, begin + 1)
        part = model.weights[slot[head[begin] : head[end]]]
        total[begin:end] = np.add.reduceat(part, head[begin:end] - head[begin], axis=0)
        begin = end
    return total / np.sqrt(np.diff(head))[:, None] + model.bias


def probabilities(model: Model, score: np.ndarray) -> np.ndarray:
    z = score / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def trigrams(text: str) -> set:
    w = text.lower().replace(",", " ").replace(".", " ").replace(";", " ").replace(":", " ").split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


_TRIGRAMS = {family: [trigrams(t) for t in of] for family, of in TEMPLATES.items()}


def confirmed(paragraph: str, family: str) -> bool:
    """Does the paragraph hold most of a template of the family, and of no other family more?"""
    held = trigrams(paragraph)

    def share(f: str) -> float:
        return max(len(t & held) / len(t) for t in _TRIGRAMS[f])

    own = share(family)
    return own >= CONFIRM and own >= max(share(f) for f in _TRIGRAMS)


def triples(h: np.ndarray) -> np.ndarray:
    """The hash of each three neighbouring words."""
    base = U64(0x9E3779B97F4A7C15)
    return mix((h[:-2] * base + h[1:-1]) * base + h[2:]) if len(h) > 2 else np.zeros(0, U64)


def indexed() -> tuple[list[tuple[str, int]], np.ndarray, list[list[tuple[int, int]]]]:
    """Each template's family and number of triples; the triples in order, and the templates and places each is at."""
    kinds, places = [], defaultdict(list)
    for family, of in TEMPLATES.items():
        for template in of:
            found = triples(plain(words(*joined(pa.array([template], pa.string())))))
            for at, x in enumerate(found.tolist()):
                places[x].append((len(kinds), at))
            kinds.append((family, len(found)))
    known = np.array(sorted(places), U64)
    return kinds, known, [places[x] for x in known.tolist()]


_KINDS, _KNOWN, _PLACES = indexed()


@dataclass
class Group:
    """Words ``begin`` to ``end`` (not with it), which hold the share of the triples of a template of the family."""

    share: float
    held: int
    family: str
    begin: int
    end: int


def groups(h: np.ndarray, block: np.ndarray) -> list[Group]:
    """Where templates may stand, the surest first: runs of words of a block with ``MAYBE`` of a template's triples, none of them twice."""
    found = triples(h)
    if not len(found):
        return []
    place = np.minimum(np.searchsorted(_KNOWN, found), len(_KNOWN) - 1)
    hits = defaultdict(list)
    for i in np.flatnonzero((_KNOWN[place] == found) & (block[:-2] == block[2:])).tolist():
        for kind, which in _PLACES[place[i]]:
            hits[kind].append((i, which))
    out = []
    for kind, of in hits.items():
        family, n = _KINDS[kind]
        held = {}  # places in the template, and the word each is found at, in the order of the words
        for i, which in [*of, (len(h) + n, None)]:
            last = next(reversed(held.values()), i)
            apart = which is None or block[i] != block[last] or i - last > n + 2
            if (apart or which in held) and len(held) >= MAYBE * n:
                out.append(Group(len(held) / n, len(held), family, next(iter(held.values())), last + 3))
                apart = True
            if apart:
                held = {}
            elif which in held:  # go on after the first of the two
                held = {k: x for k, x in held.items() if x > held[which]}
            held[which] = i
    return sorted(out, key=lambda g: (-g.share, -g.held, g.begin, g.family))


def variants(seed: int = 11) -> list[tuple[str, str]]:
    """(paragraph, family): templates with words dropped, swapped for others, or set in front."""
    rng, out = np.random.default_rng(seed), []
    spare = sorted({w for of in TEMPLATES.values() for t in of for w in t.split()})
    for family, of in TEMPLATES.items():
        for template in of:
            out.append((template, family))
            for _ in range(VARIANTS):
                w = [x for x in template.split() if rng.random() > 0.06] or template.split()
                w = [spare[rng.integers(len(spare))] if rng.random() < 0.03 else x for x in w]
                if rng.random() < 0.3:
                    w = ["Copyright", str(rng.integers(1980, 2030)), f"holder{rng.integers(1000)}", *w]
                out.append((" ".join(w), family))
    return out


def fit(sample: list[str]) -> Model:
    """The model of the template variants and the lines of a bounded sample of texts."""
    families = [*TEMPLATES, "unknown"]
    rows = [(t, families.index(f)) for t, f in variants()]
    every = set().union(*(t for of in _TRIGRAMS.values() for t in of))
    for text in sample:
        rows += [(line, len(families) - 1) for line in text.split("\n") if line.strip() and not trigrams(line) & every]
    # Notices cut short and words of notices alone are not licences.
    rng = np.random.default_rng(5)
    spare = sorted({w for of in TEMPLATES.values() for t in of for w in t.split()})
    rows += [(" ".join(rng.choice(spare, rng.integers(1, 6))), len(families) - 1) for _ in range(300)]
    rng.shuffle(rows)
    paragraphs, y = [t.replace("\n", " ") for t, _ in rows], np.array([int(c) for _, c in rows])
    data, offsets = joined(pa.array(paragraphs, pa.string()))
    w = words(data, offsets)
    slot, of = features(plain(w), w.doc)
    n = np.bincount(of, minlength=len(rows))
    weight_of = 1 / np.sqrt(np.maximum(n, 1))
    weights, bias = np.zeros((1 << BITS, len(families))), np.zeros(len(families))
    target = np.eye(len(families))[y]
    balance = 1 / np.bincount(y, minlength=len(families))[y]
    held = np.arange(len(rows)) % 5 == 0
    model = Model(families, weights, bias, 1.0)
    used, place = np.unique(slot, return_inverse=True)
    squares, bias_squares = np.full((len(used), len(families)), 1e-8), np.full(bias.shape, 1e-8)
    for _ in range(EPOCHS):
        p = probabilities(model, scores(model, slot, of, len(rows)))
        gap = (target - p) * (balance * ~held)[:, None]
        push = gap * weight_of[:, None]
        slope = np.stack([np.bincount(place, weights=push[of, c], minlength=len(used)) for c in range(len(families))], axis=1)
        slope -= 1e-4 * weights[used]
        squares += slope**2
        weights[used] += 0.3 * slope / np.sqrt(squares)
        slope = gap.sum(axis=0)
        bias_squares += slope**2
        bias += 0.1 * slope / np.sqrt(bias_squares)
    score = scores(model, slot, of, len(rows))[held]

    def loss(t: float) -> float:
        p = probabilities(Model(families, weights, bias, t), score)
        return float(-np.log(np.maximum(p[np.arange(len(p)), y[held]], 1e-12)).mean())

    temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    return Model(families, weights.astype(np.float32), bias, float(temperature))


def fit_frame(docs: DataFrame) -> Model:
    """The model, fitted in one task on about ``SAMPLE`` texts of up to ``SAMPLE_CHARS``, by a hash of the id."""
    share = SAMPLE / max(docs.count(), 1)
    sample = docs.where(
        (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 24)) < share * (1 << 24)) & (F.length("text") <= SAMPLE_CHARS)
    ).select("text")

    def run(batches):
        of = [x for b in batches for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(of))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else fit([])


@dataclass
class Notice:
    """Lines ``first`` to ``last`` that are a notice of the family, and the words that its template was found in."""

    first: int
    last: int
    family: str
    probability: float
    begin: int
    end: int

    def beside(self, family: str, h: np.ndarray, at: int) -> bool:
        """Do the line's words ``h``, the first of which is word ``at``, hold a template of the family apart from this notice?"""
        return any(
            g.family == family and (at + g.end <= self.begin or at + g.begin >= self.end) for g in groups(h, np.zeros(len(h), np.int64))
        )


def notices(m: Model, w: Words, h: np.ndarray, line: np.ndarray, every: np.ndarray) -> list[Notice]:
    """The notices of two and more neighbouring lines; no word is in those of two families."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
    at = np.flatnonzero(letters[w.end] > letters[w.start])
    h, line, every, doc = h[at], line[at], every[at], w.doc[at]
    # A block ends at a line without such words, or with its text.
    block = np.cumsum((np.diff(every, prepend=every[:1]) > 1) | (np.diff(doc, prepend=doc[:1]) > 0))
    out, taken = [], np.full(len(h), -1)
    for g in groups(h, block):
        first, last, family = int(line[g.begin]), int(line[g.end - 1]), m.families.index(g.family)
        if np.any((taken[g.begin : g.end] >= 0) & (taken[g.begin : g.end] != family)):
            continue
        begin, end = np.searchsorted(line, [first, last + 1])
        slot, of = features(h[begin:end], np.zeros(end - begin, np.int64))
        p = float(probabilities(m, scores(m, slot, of, 1))[0, family])
        text = " ".join(w.bytes_of(i).decode("utf-8", "replace") for i in at[begin:end])
        if p >= SURE and confirmed(text, g.family):
            taken[g.begin : g.end] = family
            if first < last:
                out.append(Notice(first, last, g.family, p, int(at[g.begin]), int(at[g.end - 1]) + 1))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Every text with its paragraphs, those of a confirmed family, and the likeliest of these."""
    spark = docs.sparkSession
    small_batches(spark)
    source = texts(docs)
    model = spark.sparkContext.broadcast(fit_frame(source))

    def run(batches):
        m = model.value
        for batch in slices(batches):
            data, offsets = joined(batch.column("text"))
            w = words(data, offsets)
            n = batch.num_rows
            paragraphs, licensed, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            best, families = [(0.0, None)] * n, [set() for _ in range(n)]
            if len(w.start):
                line, every = lines(data, offsets, w)
                h = plain(w)
                slot, of = features(h, line)
                p = probabilities(m, scores(m, slot, of, int(line[-1]) + 1))
                head = np.flatnonzero(np.diff(line, prepend=-1))
                tail = np.append(head[1:], len(line)) - 1
                paragraphs = np.bincount(w.doc[head], minlength=n)
                wrapped = notices(m, w, h, line, every)
                inside = {x: notice for notice in wrapped for x in range(notice.first, notice.last + 1)}
                for notice in wrapped:
                    doc = int(w.doc[head[notice.first]])
                    families[doc].add(notice.family)
                    best[doc] = max(best[doc], (notice.probability, notice.family), key=lambda x: (x[0], x[1] or ""))
                for i in inside:
                    licensed[w.doc[head[i]]] += 1
                top = p[:, :-1].argmax(axis=1)
                for i in np.flatnonzero(p[np.arange(len(p)), top] >= SURE).tolist():
                    doc, family = int(w.doc[head[i]]), m.families[top[i]]
                    text = data[w.start[head[i]] : w.end[tail[i]]].tobytes().decode("utf-8", "replace")
                    if i in inside and not inside[i].beside(family, h[head[i] : tail[i] + 1], int(head[i])):
                        continue  # a part of the notice
                    if confirmed(text, family):
                        licensed[doc] += i not in inside
                        families[doc].add(family)
                        best[doc] = max(best[doc], (float(p[i, top[i]]), family), key=lambda x: (x[0], x[1] or ""))
                    else:
                        open_[doc] += i not in inside
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(paragraphs.astype(np.int64)), pa.array(licensed), pa.array(open_),
                 pa.array([f for _, f in best], pa.string()), pa.array([x for x, _ in best], pa.float64()),
                 pa.array([sorted(f) for f in families], pa.list_(pa.string()))],
                ["doc_id", "n_paragraphs", "n_licensed", "n_unconfirmed", "family", "probability", "families"],
            )

    return source.mapInArrow(run, SCHEMA)
