import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionmill.llm import naming


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for bare, members in groups.items():
        keep = min(members)[3]
        for k, m in enumerate(sorted(members)):
            out.append((m[3], keep, len(members), k == 0, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **more):
    rows = naming.duplicates(docs, **more).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def few(block):
    """A hash of three values: nearly every block shares its hash with another."""
    return F.pmod(F.xxhash64(block), F.lit(3))


@pytest.mark.parametrize("more", [{}, {"size": 5}, {"size": 64, "hashed": few}])
def test_names_equal_brute_force(spark, edge, pairs, more):
    assert found(edge, **more) == brute(pairs)


def test_long_texts_and_hot_groups(spark):
    """Texts of many blocks that differ in one place, prefixes of each other, and a third of all rows the same."""
    base = "abc def\n" * 60_000
    rows = [(0, base), (1, base.replace(" ", "\t")), (2, base[:-5] + "X"), (3, "X" + base[1:]), (4, base + "abc"), (5, base[: len(base) // 2])]
    rows += [(10 + i, " same text " + " " * (i % 4)) for i in range(300)] + [(400 + i, f"other {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, size=1000) == brute(rows)


def test_white_space_and_emptiness(spark, nothing):
    rows = [(1, "a b"), (2, "ab"), (3, "a\x0b\x0c\rb"), (4, "a b"), (5, None), (6, ""), (7, " \t"), (8, "a\x00b"), (None, "  ab   "), (9, "ab")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert found(nothing) == []
