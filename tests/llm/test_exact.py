"""Operators with one right answer, against the library or brute force."""

import hashlib
import math
import random
import struct
import zlib

import brute_jaccard
import brute_katz
import brute_repeats
import brute_rules
import numpy as np
import pytest

from sessionmill.llm import bpe, decontaminate, fertility, jaccard, katz, repeats
from sessionmill.llm import text as T


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


# --- shared helpers -------------------------------------------------------------------------------------------


def test_words_do_not_cross_texts():
    import pyarrow as pa

    w = T.words(*T.joined(pa.array(["Ab cd", None, "", "EF", "gh\x0bI", " "])))
    assert [w.bytes_of(i) for i in range(len(w.start))] == [b"ab", b"cd", b"ef", b"gh", b"i"]
    assert w.counts.tolist() == [2, 0, 0, 1, 2, 0]


@pytest.mark.parametrize("k", [1, 2, 3, 32, 33])
def test_rolling_equals_hash_of_each_window(k):
    data = np.frombuffer(random.Random(k).randbytes(200), np.uint8)
    at = np.arange(200 - k + 1)
    assert (T.mix(T.rolling(data, k)) == T.run_hash(data, at, at + k)).all()


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 1 << 62, 1000).astype(np.uint64), np.arange(5, dtype=np.int64)):
        assert (T.unpack(T.pack(values)) == values).all()
        assert (T.unpack_sorted(T.pack_sorted(np.sort(values))) == np.sort(values)).all()
    counts = np.array([0, 3, 0, 1, 2])
    lists = np.array([1, 5, 9, 4, 0, 7], np.uint32)
    assert (T.unpack_rows(counts, T.pack_rows(counts, lists)) == lists).all()


# --- BPE ------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, edge):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    expected = []
    for doc, text in [(r["doc_id"], r["text"]) for r in edge.collect()]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows(bpe.digests(edge), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)


def test_bpe_round_trip_and_encoded_documents(spark, edge, nothing):
    encoded = bpe.encode_frame(edge)
    assert rows(bpe.decode_frame(encoded), "doc_id", "text") == rows(encoded, "doc_id", "decoded")
    whole = bpe.encoded_documents(edge)
    assert rows(whole, "doc_id", "ids") == rows(encoded, "doc_id", "ids")
    assert rows(whole, "doc_id", "n_tokens", "ids_sha256") == rows(bpe.digests(edge), "doc_id", "n_tokens", "ids_sha256")
    assert bpe.digests(nothing).count() == 0


def test_cache_stays_bounded():
    t = bpe.WordBpe(bpe.default_vocabulary(), cache_words=10)
    first = [t.encode(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    assert len(t.words) <= 10 and len(t.words.old) <= 10
    assert first == [t.encode(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]


# --- near duplicates ------------------------------------------------------------------------------------------


def test_components_equal_brute_force(spark, edge, pairs, nothing):
    got = jaccard.near_duplicates(edge)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_jaccard.near_duplicates(pairs)
    assert jaccard.near_duplicates(nothing).count() == 0


def test_links_equal_brute_force(spark, edge, pairs):
    classes = {}
    for doc, text in pairs:
        s = brute_jaccard.shingle_set(text)
        if s and doc is not None:
            classes[s] = min(classes.get(s, doc), doc)
        elif s:
            classes.setdefault(s, None) if s not in classes else None
    expected = set()
    sets = list(classes)
    for i, x in enumerate(sets):
        for y in sets[:i]:
            if 100 * len(x & y) >= 80 * len(x | y) and None not in (classes[x], classes[y]):
                expected.add((min(classes[x], classes[y]), max(classes[x], classes[y])))
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in jaccard.links(edge).collect() if r["doc_id_a"] is not None and r["doc_id_b"] is not None}
    assert got == expected and expected


def test_small_sets_with_a_common_passage(spark):
    """Sets near the threshold, of all small sizes, that share a passage: where empty and frequent segments abound."""
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(8))
    texts = []
    for i in range(240):
        own = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 14))]
        texts.append((i, common + " " + " ".join(own)))
        if rng.random() < 0.5 and own:
            own[-1] = "z"
            texts.append((1000 + i, common + " " + " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard.near_duplicates(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_jaccard.near_duplicates(texts)


@pytest.mark.parametrize("rows_of_a_tile", [2048, 40])
def test_a_large_group_of_near_copies(spark, monkeypatch, rows_of_a_tile):
    """Copies with a few words replaced, most pairs just above or below the threshold: no table holds the pairs of the group, and its
    components are those of all pairs, whether its sets meet in one block or in many."""
    rng, texts, written = random.Random(5), [], {}
    for i in range(150):
        w = [f"b{k}" for k in range(400)]
        for at in rng.sample(range(400), rng.randrange(4, 8)):
            w[at] = f"own{i}x{at}"
        texts.append((i, " ".join(w)))
    keep = jaccard.Steps.keep

    def counted(self, frame, name):
        written[name] = keep(self, frame, name).count() if name in ("open", "near", "tried") else None
        return self.spark.read.parquet(f"{self.folder}/{name}") if written[name] is not None else keep(self, frame, name)

    monkeypatch.setattr(jaccard.Steps, "keep", counted)
    monkeypatch.setattr(jaccard, "TILE_ROWS", rows_of_a_tile, raising=False)
    got = rows(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard.near_duplicates(texts)
    assert 1 < len({c for _, _, c in got}) < 150
    assert 0 < written["tried"] < 150
    assert 0 < written["near"] < written["open"]  # a row for each class of a run at most


def test_a_run_yields_fewer_rows_than_it_has_classes():
    """60 classes, each in a component of its own, all near one another: 1770 pairs."""
    import pyarrow as pa

    parity = [[i, 0, 0, 0, 0, 0, 0, 0] for i in range(60)]
    run = pa.table({"class": list(range(60)), "component": list(range(60)), "n": pa.array([100] * 60, pa.int32()), "parity": pa.array(parity, pa.list_(pa.int64()))})
    forest = jaccard.near_forest(run, run)
    assert sorted(forest.column("b").to_pylist()) == list(range(1, 60)) and set(forest.column("a").to_pylist()) == {0}


def test_wide_parities_bound_what_sets_do_not_share():
    """Whatever the widths: no more than the members not in common, and for sets without common members too many for a link."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = np.array([0, 300, 853, 854, 900, 1000, 1700, 1710, 2100, 5000, 6200])
    sets = [np.sort(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in n]
    wide = jaccard.wide_parities(np.concatenate(sets), n)
    assert [w and len(w) for w in wide] == [None, None, None, 16, 16, 16, 16, 32, 32, 64, 64]
    table = pa.table({"wide": pa.array(wide, pa.list_(pa.int64()))})
    forms = jaccard.Wide(table)
    for i in range(3, len(n)):
        for j in range(3, i):
            if 100 * n[j] >= 80 * n[i]:
                size = min(forms.size[i], forms.size[j])
                apart = jaccard._apart(forms.of(np.array([i]), size), forms.of(np.array([j]), size))[0]
                assert n[i] + n[j] < 9 * apart <= 9 * (n[i] + n[j])
    near = np.sort(np.concatenate([sets[8][:1705], rng.integers(0, 1 << 62, 5).astype(np.uint64)]))
    one, two = jaccard.wide_parities(np.concatenate([sets[8][:1700], near]), np.array([1700, 1710]))
    one, two = np.array(one), np.array(two)
    assert len(two) == 2 * len(one) and np.bitwise_count((two[: len(one)] ^ two[len(one) :]) ^ one).sum() <= 10


@pytest.mark.parametrize("rows_of_a_part", [512, 2])
def test_large_texts_with_a_common_passage_are_not_near(spark, monkeypatch, rows_of_a_part):
    """Large texts that agree on segments of a passage and on nothing else: only links are written with their sets, and no table
    holds the segments' keys."""
    rng, texts, written = random.Random(8), [], {}
    passage = [f"c{i}" for i in range(200)]
    for i in range(7):  # fewer than FREQUENT
        texts.append((i, " ".join(passage + [f"own{i}x{k}" for k in range(1800 + rng.randrange(200))])))
    w = texts[4][1].split()
    w[700] = w[1500] = "changed"
    texts.append((100, " ".join(w)))
    keep = jaccard.Steps.keep

    def counted(self, frame, name):
        written[name] = keep(self, frame, name).collect()
        assert not {"keys", "owners"} & set(frame.columns)
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    monkeypatch.setattr(jaccard.Steps, "keep", counted)
    monkeypatch.setattr(jaccard, "RUN_ROWS", rows_of_a_part, raising=False)
    got = rows(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard.near_duplicates(texts)
    assert len({c for _, _, c in got}) == 7
    assert len(written["edges"]) == 1 and len(written["open"]) > 1 and not written["near"]


@pytest.mark.parametrize("links_of_a_block", [1 << 19, 7, 0])
def test_few_tables_are_written_for_components(spark, monkeypatch, links_of_a_block):
    """A path, a ring, a star, repeated and self-links: the same from one block of links, which is one table, and from many."""
    from sessionmill.llm import graph

    rng = random.Random(11)
    path = rng.sample(range(1000, 1300), 300)
    pairs = [*zip(path, path[1:]), *((2000 + i, 2000 + (i + 1) % 40) for i in range(40)), *((3000, 3001 + i) for i in range(50)), (7, 7), (3001, 3000), (3000, 3001)]
    rng.shuffle(pairs)
    steps, keep, written = jaccard.Steps(spark), jaccard.Steps.keep, []
    monkeypatch.setattr(jaccard.Steps, "keep", lambda self, frame, name: written.append(name) or keep(self, frame, name))
    monkeypatch.setattr(graph, "BLOCK_LINKS", links_of_a_block, raising=False)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = sorted(map(tuple, graph.components(links, steps, "c").collect()))
    assert got == sorted([(n, min(path)) for n in path] + [(2000 + i, 2000) for i in range(40)] + [(3000 + i, 3000) for i in range(51)])
    assert links_of_a_block < len(pairs) or len(written) == 1


def test_one_row_of_each_component_is_kept(spark, edge, pairs):
    kept = jaccard.kept(edge)
    assert kept.columns == edge.columns
    least = {}
    for doc, _, component in brute_jaccard.near_duplicates(pairs):
        least.setdefault(component, []).append(doc)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sum(d is not None for d in ids) == len({d for d in ids if d is not None}) + (ids.count(16) - 1)
    assert set(ids) - {None} == {c for c in least if c is not None}


# --- repeats --------------------------------------------------------------------------------------------------


def distinct_ids(pairs):
    """The first row of each id; two null ids would need an order."""
    seen, out = set(), []
    for doc, text in pairs:
        if doc not in seen:
            out.append((doc, text))
            seen.add(doc)
    return out


def test_repeats_equal_brute_force(spark, edge, pairs, nothing):
    unique = distinct_ids(pairs)
    docs = spark.createDataFrame(unique, "doc_id long, text string").repartition(3)
    got = repeats.digests(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute_repeats.digests(unique), key=str)
    assert repeats.digests(nothing).count() == 0
    # Equal rows are one document: each has the result of the one.
    twice = rows(repeats.digests(docs.union(docs)), "doc_id", "n_removed", "kept_sha256")
    once = rows(got, "doc_id", "n_removed", "kept_sha256")
    assert twice == sorted(once + once, key=str)


def test_cleaned_rows_keep_their_columns(spark, edge):
    out = repeats.cleaned(edge)
    assert out.columns == edge.columns and out.schema["n_chars"].dataType == edge.schema["n_chars"].dataType
    found = {r["doc_id"]: r for r in out.collect()}
    assert 1 not in found and found[0]["text"] and found[0]["n_chars"] == len(found[0]["text"])
    assert found[4]["text"] is None and found[5]["text"] == ""


def test_block_sort_agrees_with_comparing_all():
    rng = np.random.default_rng(2)
    around = rng.integers(97, 99, (40, repeats.WIDTH)).astype(np.uint8)
    around[20:] = around[rng.integers(0, 20, 20)]
    around[30:, :30] = 97
    valid, prior = rng.random((40, repeats.REACH + 1)) < 0.9, rng.permutation(40)
    got = repeats.sort_block(around, valid, prior)
    for o in range(repeats.REACH + 1):
        for i in range(40):
            expected = valid[i, o] and any(
                valid[j, o] and prior[j] < prior[i] and (around[j, o : o + 100] == around[i, o : o + 100]).all() for j in range(40)
            )
            assert got[i, o] == expected


# --- Katz -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [2_000, 1 << 20])
def test_katz_equals_dictionaries(spark, edge, chunk, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    of = [(r["doc_id"], r["text"]) for r in edge.collect()]
    model = brute_katz.model([t for d, t in of if learn(d)])
    expected = sorted(((d, *brute_katz.score(model, t)) for d, t in of), key=str)
    got = katz.held_out_scores(edge).collect()
    assert all(r["train_tokens"] == model[1] for r in got)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=str)
    for g, e in zip(got, expected, strict=True):
        assert g[:3] == e[:3] and math.isclose(g[3], e[3], rel_tol=1e-9) and math.isclose(g[4], e[4], rel_tol=1e-9)


def test_katz_distributions_sum_to_one(pairs):
    uni, n, p1, unknown, cond, alpha = brute_katz.model([t for d, t in pairs if d is not None])
    assert math.isclose(sum(p1.values()) + unknown, 1)
    for h, seen in cond.items():
        assert math.isclose(sum(seen.values()) + alpha[h] * (1 - sum(p1[w] for w in seen)), 1)


def test_katz_without_training_texts(spark, nothing):
    assert katz.held_out_scores(nothing).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert rows(katz.held_out_scores(docs), "n_tokens", "n_known", "score") == [(1, 0, 0.0), (4, 0, 0.0)]


# --- quality rules --------------------------------------------------------------------------------------------


def test_base_rules_equal_brute_force(spark, edge, pairs, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = fertility.judged(edge).collect()
    expected = sorted(((d, *brute_rules.base(t)) for d, t in pairs), key=str)
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=str) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert fertility.judged(nothing).count() == 0


def test_fertility_counts_tokens(spark):
    import pyarrow as pa
    import sentencepiece

    files = fertility.default_files()
    library = sentencepiece.SentencePieceProcessor(model_file=files[0])
    text = "some words and 漢字 some words zzzzqx"
    w = T.words(*T.joined(pa.array([text, ""])), lower=False)
    n, fallback, _, entropy = fertility.fertility(fertility.Pieces(*files), w)
    ids = [i for x in text.split() for i in library.encode(x)]
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert n.tolist() == [len(ids), 0] and fallback[0] == sum(library.is_byte(i) for i in ids)
    assert math.isclose(entropy[0], -(share * np.log2(share)).sum()) and entropy[1] == 0


def test_bands_reject_outliers(spark):
    rng = random.Random(5)
    rest = [(i, " ".join(rng.choice(["house", "table", "window", "garden", "street", "people"]) + str(rng.randrange(9)) for _ in range(60)), "en") for i in range(60)]
    odd = [(99, " ".join("ⴰⵣⵓⵍ" + chr(0x2D30 + i % 40) for i in range(60)), "en")]
    out = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(rest + odd, "doc_id long, text string, lang string")).collect()}
    assert not out[99] and all(out[i] for i in range(60))


def test_bands_part_junk_from_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [r for r in fertility.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect() if not r["base_failed"]]
    junk = [r["kept"] for r in passed if quality.get(r["doc_id"]) == 0]
    clean = [r["kept"] for r in passed if quality.get(r["doc_id"]) == 1]
    assert len(junk) > 20 and np.mean(junk) < 0.25
    assert len(clean) > 300 and np.mean(clean) > 0.95


def test_bands_of_equal_quartiles_keep_their_neighbours(spark):
    rng = random.Random(6)
    copy = " ".join(rng.choice(["house", "table", "window", "garden", "street", "people"]) + str(rng.randrange(9)) for _ in range(60))
    rest = [(i, copy, "en") for i in range(60)] + [(60, copy.rsplit(" ", 1)[0], "en")]
    out = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(rest, "doc_id long, text string, lang string")).collect()}
    assert all(out.values()) and len(out) == 61


# --- decontamination ------------------------------------------------------------------------------------------


def greedy(item, doc, least):
    """Tiles by looking at all places, longest first."""
    out, used_i, used_d = [], set(), set()
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        used_i |= set(range(best[0], best[0] + best[2]))
        used_d |= set(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_greedy_search(seed):
    rng = np.random.default_rng(seed)
    item, doc = rng.integers(1, 4, 24).astype(np.uint64), rng.integers(1, 4, 60).astype(np.uint64)
    got = decontaminate.tiles(T.mix(item), T.mix(doc), 3)
    expected = greedy(item.tolist(), doc.tolist(), 3)
    assert sum(n for _, _, n in got) == sum(n for _, _, n in expected)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in expected)


def test_reordered_passages_are_found(spark, edge, nothing, monkeypatch):
    words = [f"q{i}" for i in range(40)]
    parts = [words[i : i + 10] for i in range(0, 40, 10)]
    moved = " ".join(" ".join(parts[i]) + ", and then" for i in (2, 0, 3, 1))
    bench = spark.createDataFrame(
        [(1, " ".join(words), "x"), (2, "q0 q1 q2", "x"), (3, None, "x"), (None, "some other words that no text has", "x"), (1, " ".join(words), "x")],
        "item_id long, text string, score string",
    )
    extra = [(100, "Before it. " + moved.upper(), *[None] * 8), (101, " ".join(words[:15]), *[None] * 8), (101, " ".join(words[:30]), *[None] * 8)]
    docs = edge.union(spark.createDataFrame(extra, edge.schema))
    for size in (1 << 20, 40):  # all items at once, and one by one
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = [r for r in decontaminate.matches(docs, bench).collect() if r["contaminated"]]
        assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["items"]) for r in got) == [(100, 1, 4, [1]), (101, 1, 1, [1])]
        kept = decontaminate.kept(docs, bench)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.matches(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.matches(edge, bench.limit(0)).collect())


def test_items_without_an_id_are_found(spark, monkeypatch):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    bench = spark.createDataFrame([(None, one), (None, two), (7, three), (None, three), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + one), (2, two + " so " + one), (3, three), (4, "so " + three + " " + two), (5, "none of them")], "doc_id long, text string")
    for size in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = rows(decontaminate.matches(docs, bench), "doc_id", "contaminated", "item_id", "coverage", "items")
        assert got == [
            (1, True, None, 1.0, [None]), (2, True, None, 1.0, [None]), (3, True, 7, 1.0, [7, None]), (4, True, 7, 1.0, [7, None]),
            (5, False, None, 0.0, []),
        ]
        assert [r["doc_id"] for r in decontaminate.kept(docs, bench).collect()] == [5]
