import hashlib
import zlib
from collections import defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionmill.llm import manifest, sha
from sessionmill.llm.queries import QUERIES
from sessionmill.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def field(value):
    raw = b"" if value is None else str(value).encode()
    return b"-" if value is None else str(len(raw)).encode() + b":" + raw


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    """The query's rows from (doc_id, source, lang, n_chars, text), each node hashed from its start."""
    trees, out = defaultdict(list), []
    for doc, source, lang, n, text in rows:
        head = b"".join(map(field, (doc, source, lang, n)))
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        trees[source].append((doc, digest(head + field(text)), digest(head + field(low if bad else text))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for source in order:
        trees[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        grown[source] = levels([leaf for _, leaf, _ in trees[source]])
    forest = levels([grown[s][-1][0] for s in order])
    for k, source in enumerate(order):
        for i, (doc, leaf, now) in enumerate(trees[source]):
            proof = ""
            for tree, at in ((grown[source], i), (forest, k)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    now, at = digest("".join(run[:slot] + [now] + run[slot + 1 :])), at // 16
            out.append((doc, leaf, grown[source][-1][0], forest[-1][0], digest(proof), now, now == forest[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.verified(manifest.leaves(docs, manifest.tampered(docs))).collect()), key=str)


def test_resumed_states_hash_as_the_library():
    digests = [digest(str(i)) for i in range(40)]
    blocks = sha.as_blocks("".join(digests).encode())
    state = np.repeat(sha.START[:, None], 20, axis=1)
    for half in (blocks[:20], blocks[20:]):
        state = sha.step(state, half.T)
    assert sha.text_of(sha.as_hex(sha.closed(state, np.full(20, 2)))) == [digest(a + b) for a, b in zip(digests[:20], digests[20:], strict=True)]


def test_manifest_of_odd_rows(spark, edge, nothing):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in edge.collect()]
    assert found(edge) == brute(rows)
    assert found(nothing) == []
    assert found(edge.where("doc_id = 9")) == brute([r for r in rows if r[0] == 9])


@pytest.mark.parametrize("sizes", [[16, 17, 1], [300, 1, 256, 15], [1] * 20, [4097]])
def test_manifests_of_all_heights(spark, sizes):
    """Full and one over full runs, lone leaves, more than one level of sources; one source with most rows."""
    rows = [(1000 * s + i, None if s == 0 else f"Ü{s}", "en", i, f"Text {i % 7} of {s}") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_a_fold_reads_no_left_sibling():
    """The kept state stands for what is to the left: with left siblings overwritten, the fold is the same."""
    digests = [digest(str(i)) for i in range(5)]
    state = np.repeat(sha.START[:, None], 1, axis=1)
    for d in digests[:3]:
        state = sha.step(state, sha.as_blocks(d.encode()).T)
    new, junk = digest("new"), "0" * 64
    words = manifest._resume(
        sha.as_blocks(new.encode()), state.T, np.array([3]), np.array([5]), np.array([0]), sha.as_blocks((junk * 4 + digests[4]).encode())
    )
    assert sha.text_of(words) == [digest("".join([*digests[:3], new, digests[4]]))]


@pytest.mark.parametrize("name", ["op11_manifest", "op12_naming", "op13_repair"])
def test_query_equals_sql(spark, name):
    assert compare.difference(spark, compare.connect(SF), SF, QUERIES[name], ORACLE[name]) == ""


def test_changed_rows_need_not_be_text(spark, edge):
    """The operator takes any replacement, not the query's damage alone."""
    changed = manifest.verified(manifest.leaves(edge, F.when(F.col("doc_id") == 16, F.lit("other")))).collect()
    assert all(r["verified"] == (r["doc_id"] != 16) for r in changed)
