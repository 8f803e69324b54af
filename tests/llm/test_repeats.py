"""Buckets of the removal of repeats: how even they are, and what is merged before they meet."""

import brute_repeats
import numpy as np
import pyarrow as pa

from sessionmill.llm import repeats


def lines(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_anchors_are_spread_evenly_over_buckets():
    rng = np.random.default_rng(5)
    h, *_ = repeats.anchors(rng.integers(97, 123, 400_000).astype(np.uint8), np.array([0, 400_000]))
    sizes = [j - i for _, i, j in repeats.dealt(np.sort(h), 32)]
    assert len(sizes) == 32 and max(sizes) < 1.5 * np.mean(sizes)


def test_dealt_covers_all_hashes_and_skips_empty_buckets():
    h = np.array([0, 1, 5 << 61, (1 << 64) - 1], np.uint64)
    assert repeats.dealt(h, 4) == [(0, 0, 2), (2, 2, 3), (3, 3, 4)]
    assert repeats.dealt(h[:0], 4) == []


def test_equal_surroundings_are_merged_before_the_bucket():
    passage = "".join(np.random.default_rng(1).choice(list("abcdefg"), 168))
    data, _ = lines([passage])
    n = 50
    found = repeats.Anchors(
        np.full(n, 7, np.uint64), np.repeat(data[None, :], n, axis=0), np.arange(n), np.zeros(n, np.uint8), np.zeros(n, np.int64),
        np.full(n, 68, np.uint32), np.full(n, 68, np.uint8), np.zeros(n, np.uint8),
    )
    blocks = [row for batch in repeats._flush(found, 4, 9) for row in batch.to_pylist()]
    assert sorted(len(b["blobs"]) for b in blocks) == [5, 8]
    assert {len(b["blobs"]): b["bucket"] for b in blocks}[5] == 1
    sent = next(b["blobs"] for b in blocks if len(b["blobs"]) == 8)
    assert len(repeats.unpack_sorted(sent[0])) == 1
    spans = repeats.resolve(pa.Table.from_pylist(blocks, pa.schema([("bucket", pa.int32()), ("blobs", pa.list_(pa.binary()))])))
    assert spans.column("doc_id").to_pylist() == list(range(1, n))
    assert set(map(tuple, spans.column("begin").to_pylist())) == {(0,)} and set(map(tuple, spans.column("end").to_pylist())) == {(168,)}


def test_hot_passage_and_runs_of_one_byte_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    hot = word(230)
    docs = [(i, word(int(rng.integers(0, 120))) + hot + word(int(rng.integers(0, 120)))) for i in range(60)]
    docs += [(60, "x" * 700), (61, "y" + "x" * 300), (62, "ab" * 300), (63, hot[:130]), (64, None), (65, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = repeats.digests(frame).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in brute_repeats.digests(docs))


def test_results_do_not_hang_on_the_number_of_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    shared = [word(150) for _ in range(5)]
    frame = spark.createDataFrame([(i, word(50) + shared[i % 5] + word(60)) for i in range(40)], "doc_id long, text string")
    few = sorted(tuple(r) for r in repeats.digests(frame).collect())
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 64)
    assert sorted(tuple(r) for r in repeats.digests(frame).collect()) == few
