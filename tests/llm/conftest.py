import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, begin int, chunk string, n long"


def edge_rows():
    """Nulls, empty and long texts, repeated rows, near and exact copies, ties, and columns with names the operators use."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))

    base, passage = prose(120), prose(60)
    near = base.split()
    near[60] = "changed"
    out = [
        (0, base, "en"), (1, base, "en"), (2, " ".join(near), "en"), (3, base.upper(), "de"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"),
        (7, "one two", "en"), (8, "one two", "en"), (9, prose(4000), "en"), (10, "x" * 3000, "fr"), (11, "go " * 900, "fr"),
        (12, prose(30) + "\n" + passage, "de"), (13, passage + "\n" + prose(40), None), (14, prose(20) + " " + passage, "es"),
        (None, prose(80), "en"), (None, passage + " " + passage, "fr"), (15, base, "en"), (15, base, "en"), (16, prose(50), "en"), (16, prose(60), "en"),
        (17, "Ünïcödé ÄÖÜ ß é " * 30, "de"), (18, "漢字テスト 👍🏽 " * 20, None), (19, "...", "en"), (20, "12345 67890", "en"),
        (21, "All rights reserved.\nLicensed under CC BY-NC 4.0.\n" + prose(30), "en"), (22, "line\nline\n\nline\n" + prose(25), "en"),
        (23, "a<|endoftext|>B <|startoftext|>", "en"), (-4, prose(70), "en"),
    ]
    for i in range(30, 60):
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w[rng.randrange(3) :]), "en"))
    return [(d, t, l, None if d is None else "s", None if t is None else len(t), 1.0, 5, 2, "c", 3) for d, t, l in out]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in edge_rows()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
