"""The stages on odd rows, and the whole against brute force."""

import hashlib
import struct

import brute_jaccard
import brute_repeats
import corpus_pipeline

from test_exact import greedy

from sessionmill.llm import bpe, decontaminate
from sessionmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "encoding"]


def test_stages_take_odd_rows(spark, edge, nothing):
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), edge.schema)
        assert docs.columns == edge.columns
    ids = {r["doc_id"] for r in docs.collect()}
    assert 0 in ids and not ids & {1, 2, 4, 5, 6, 15, 19, 20} and ids >= {9, 12, -4}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SF).count() == 0
    assert corpus_pipeline.encode(spark, nothing, SF).count() == 0


def test_run_equals_brute_force(spark):
    """Languages of this table are clear, so the first stage keeps all; the others are spelled out."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    components = {d: c for d, _, c in brute_jaccard.near_duplicates(docs)}
    docs = sorted((d, t) for d, t in docs if components[d] == d)
    cut = {d: (n, h) for d, _, n, _, h in brute_repeats.digests(docs)}
    bench = [brute_jaccard.word_list(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    seen = set()
    for doc, text in docs:
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert hashlib.sha256(kept).hexdigest() == cut[doc][1]
        kept = kept.decode("utf-8", "ignore")
        plain = " ".join(w.strip(".,;:!?\"'()[]{}") or w for w in brute_jaccard.word_list(kept))
        leaked = any(
            sum(n for _, _, n in greedy([w.strip(".,;:!?\"'()[]{}") or w for w in item], plain.split(), 5)) >= decontaminate.COVERAGE * len(item)
            for item in bench if any(" ".join(w.strip(".,;:!?\"'()[]{}") or w for w in item[i : i + 5]) in plain for i in range(len(item) - 4))
        )
        assert (doc in got) == (not leaked and bool(kept.split())), doc
        if doc in got:
            ids = library.encode(kept, add_special_tokens=False).ids
            assert got[doc]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert got[doc]["ids"] == ids
