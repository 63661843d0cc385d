"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, component_id string, ids string, fp string, key string"


def make_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        rows.append((i, " ".join(words), rng.choice(["en", "fr"]), f"s{i % 4}"))
        if i % 6 == 0:
            close = list(words)
            close[len(close) // 2] = "changed"
            rows.append((100 + i, "  ".join(words).upper(), "en", "s0"))
            rows.append((200 + i, " ".join(close), "fr", "s1"))
    rows += [
        (300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "fr", None), (303, "one", "en", "s2"), (303, "one", "en", "s2"),
        (None, "no id at all here", "en", "s3"), (None, None, None, None), (304, "word " * 30000, "en", "s0"), (305, "é" * 50000, "fr", "s0"),
        (306, "!!! 123 ???", "en", "s0"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 7, "x", "y", "z", "k") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
