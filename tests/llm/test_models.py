"""Trained operators: held-out accuracy, and defined results in odd cases."""

import random

import numpy as np
import pytest

from sessionmill.llm import language, licences, toxicity, warc
from sessionmill.llm.frames import Steps


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


SYLLABLES = {
    "aa": ["ka", "to", "mi", "su", "re"], "bb": ["str", "ent", "ung", "sch", "er"], "cc": ["qua", "lle", "eau", "oi", "ch"],
    "dd": ["ció", "ñas", "que", "ll", "os"], "ee": ["zv", "ski", "ov", "yn", "ja"], "ff": ["hh", "ww", "kk", "iz", "ux"],
}


@pytest.fixture(scope="module")
def spoken(spark):
    rng, names = random.Random(1), list(SYLLABLES)
    rows = [(i, invented(rng, SYLLABLES[names[i % 6]], 30), names[i % 6], 0.5) for i in range(360)]
    rows += [(None, "kato mire", None, None), (900, None, "aa", None), (901, "", "bb", None), (902, "123 ...", None, None), (5, rows[5][1], "ff", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)


def test_languages_are_told_apart(spoken):
    out = language.held_out_predictions(spoken).collect()
    assert len(out) == 365
    truth = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 40 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    odd = {r["doc_id"]: r for r in out if r["doc_id"] in (900, 901, 902)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd.values())
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_stage_keeps_columns(spoken):
    kept = language.kept(spoken)
    assert kept.columns == spoken.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {900, 901, 902} and len(ids & set(range(360))) > 340


def test_language_without_a_choice(spark, nothing):
    assert language.predict(nothing).count() == 0
    one = spark.createDataFrame([(1, "some text", "en"), (2, "other", "en"), (3, "...", "en")], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(one).collect()} == {(1, "en", 1.0), (2, "en", 1.0), (3, "und", 0.0)}
    none = one.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.predict(none).collect()} == {"und"}


def test_language_learns_from_rows_of_a_fixed_size(spark):
    rng = random.Random(4)
    docs = [(i, invented(rng, SYLLABLES["aa"], 1 << (2 * i)), "aa") for i in range(10)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = language.training_sample(docs)
    assert rows.columns == ["digest", "lang", "counts"] and rows.count() == 10
    assert max(len(r["counts"]) for r in rows.collect()) < 8 * (language.PAIRS + language.TRIPLES)


@pytest.mark.parametrize("text", ["", "ab", "abc", "a text looked at in pieces, aaaaaaaaaaaa"])
def test_pieces_count_as_the_whole(text):
    data = np.frombuffer(text.encode(), np.uint8)
    whole = language.counted(data)
    assert whole.sum() == (2 * len(text) - 3 if len(text) > 2 else 0)
    assert all((language.counted(data, step) == whole).all() for step in (1, 2, 3, 7))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= (1 if n == 2 else code.shape[1] // 4)
    assert not (np.abs(code.sum(axis=0)) == n).any()


def test_sums_stay_within_texts():
    import pyarrow as pa

    from sessionmill.llm.text import joined

    of = ["hello world", "", "x", "another one", "ab"]
    rng = np.random.default_rng(0)
    codes = language.Codes(["a", "b"], language.codewords(2), rng.normal(size=(1, language.PAIRS)), rng.normal(size=(1, language.TRIPLES)), np.zeros(1))
    together = language.margins(codes, *joined(pa.array(of)))
    alone = np.concatenate([language.margins(codes, *joined(pa.array([t]))) for t in of])
    assert np.allclose(together[[0, 1, 2, 3]], alone[[0, 1, 2, 3]])


# --- toxicity -------------------------------------------------------------------------------------------------

BAD = ["wretch", "vermin", "dullard", "trollop", "scoundrel"]


@pytest.fixture(scope="module")
def talk(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        w = invented(rng, SYLLABLES["aa"] + SYLLABLES["bb"], rng.randrange(20, 120)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w) + ".", "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "wretch", "x"), (1000, None, "x"), (1001, "", "x"), (3, rows[3][1], "x"), (1002, "Vermin " * 5000, "x")]
    labels += [(None, 1, 1), (2000, 1, 1), (8, 1, None), (12, 1, 0), (1000, 1, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, expected string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxic_texts_are_found(talk):
    docs, labels = talk
    out = toxicity.held_out_scores(docs, labels).collect()
    assert len(out) == 405
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = [text[r["doc_id"]][s["begin"] : s["end"]].strip(".") for r in held for s in r["spans"]]
    assert words and np.mean([all(x in BAD for x in w.split()) for w in words]) > 0.9


def test_toxicity_without_labels(talk, nothing):
    docs, labels = talk
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.score(nothing, labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    move = np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([6, 4, 1])
    begin = np.cumsum(lengths) - lengths
    e = rng.normal(size=lengths.sum())
    p, pairs = toxicity.marginals(e, move, begin, lengths, pairs=True)
    total = np.zeros((2, 2))
    for b, n in zip(begin, lengths, strict=True):
        weight, one, count = 0.0, np.zeros(n), np.zeros((2, 2))
        for state in np.ndindex(*[2] * n):
            w = np.exp(sum(e[b + t] * s for t, s in enumerate(state))) * np.prod([move[x, y] for x, y in zip(state, state[1:])])
            weight += w
            one += w * np.array(state)
            for x, y in zip(state, state[1:]):
                count[x, y] += w
        assert np.allclose(p[b : b + n], one / weight)
        total += count / weight
    assert np.allclose(pairs, total)


# --- licences -------------------------------------------------------------------------------------------------


def test_licences_are_recognised(spark, edge, nothing):
    rng = random.Random(9)
    rows, truth = [], {}
    for i, (family, of) in enumerate(licences.TEMPLATES.items()):
        for j, template in enumerate(of):
            doc = 1000 + 10 * i + j
            rows.append((doc, invented(rng, SYLLABLES["cc"], 40) + "\n" + template.upper() + "\n" + invented(rng, SYLLABLES["bb"], 10)))
            truth[doc] = [family]
    rows += [(5000, "the license of the author is for his work\nall rights are for the people"), (5001, None), (5002, "")]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert np.mean([got[d]["families"] == f for d, f in truth.items()]) > 0.9
    assert got[21]["families"] == ["cc-by-nc", "proprietary"] and got[21]["n_licensed"] == 2
    assert all(not got[d]["families"] for d in (5000, 5001, 5002, 0, 9, 10, 18))
    assert got[5001]["n_paragraphs"] == 0 and got[22]["n_paragraphs"] == 4
    assert licences.scan(nothing).count() == 0


WRAPPED = {
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
}


def test_wrapped_notices_are_seen_whole(spark):
    rng, rows, truth = random.Random(3), [], {}
    for i, (family, notice) in enumerate(WRAPPED.items()):
        narrow = notice.replace("\n", " ").split()
        narrow = "\n".join(" ".join(narrow[k : k + 5]) for k in range(0, len(narrow), 5))
        for j, text in enumerate((notice, narrow)):
            for k, mark in enumerate(("", "# ", " * ", "// ")):
                prose = "".join(invented(rng, SYLLABLES["cc"], 12) + "\n" for _ in range(3))
                marked = "".join(f"{mark}{x}\n" for x in text.split("\n"))
                doc = 100 * i + 10 * j + k
                rows.append((doc, prose + "\n" + marked + "\n" + prose if k % 2 else marked + prose))
                truth[doc] = [family]
    both = WRAPPED["bsd"] + "\n" + WRAPPED["gpl"] + "\nReleased under the MIT license.\n"
    one = " ".join(WRAPPED["lgpl"].split()[:21]) + " License\nand not the GNU General Public License"
    rows += [(903, one), (900, both), (901, "\n\n".join(WRAPPED["gpl"].split("\n")[:2])), (902, "This program is free software:\nyou can buy it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert {d: got[d]["families"] for d in truth} == truth
    assert all(2 <= got[d]["n_licensed"] <= got[d]["n_paragraphs"] for d in truth)
    assert got[900]["families"] == ["bsd", "gpl", "mit"]
    assert got[903]["families"] == ["lgpl"]
    assert got[901]["families"] == got[902]["families"] == []


# --- archives -------------------------------------------------------------------------------------------------


def test_audit_finds_damage_and_nothing_else(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h/{i}", "p" * (i % 50) * 40, "x") for i in range(3000)] + [(7, "http://h/7", "p" * 280, "y"), (None, None, None, None), (None, "u", "h", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(4)
    text, page = warc.record(F.col("url"), F.col("html")), F.col("page_id")
    bad, lost = [3, 1500, 2999], [64, 65, 2048]
    replica = F.when(page.isin(bad), F.concat(text, F.lit("!"))).when(page.isin(lost), F.lit(None)).otherwise(text)
    got = {r["page_id"]: r for r in warc.audited(pages, replica).collect()}
    assert sorted(k for k, r in got.items() if r["status"] == "corrupt") == bad
    assert sorted(k for k, r in got.items() if r["status"] == "missing") == lost
    assert got[7]["copies"] == 2 and len(got) == 3001
    clean = warc.audited(pages, text)
    assert {r["status"] for r in clean.collect()} == {"ok"}
    assert warc.audited(pages.limit(0), text).count() == 0


def test_audit_of_other_offsets(spark):
    one = spark.createDataFrame([("a", i * 100, 100, f"d{i}") for i in range(2000)] + [("b", 0, 9, "x")], "archive string, offset long, length long, digest string")
    two = one.where("offset <> 700 and archive = 'a'").union(spark.createDataFrame([("a", 150, 5, "new"), ("c", 0, 5, "z")], one.schema))
    found = {(r["archive"], r["offset"], r["status"]) for r in warc.audit(one, two, Steps(spark)).collect()}
    assert found == {("a", 700, "missing"), ("a", 150, "extra"), ("b", 0, "missing"), ("c", 0, "extra")}
