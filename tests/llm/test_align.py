"""Alignment held against a plain walk over both tokenizers' tokens, and against tokens made by the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.llm import align as A

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def both():
    return A.load(A.default_vocabulary(), A.default_pieces())


def walk(a, b, sizes_a, sizes_b):
    """Groups and links of one text, token by token."""
    spans = []
    for ids, sizes in ((a, sizes_a), (b, sizes_b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + sizes[i]))
            at += sizes[i]
        spans.append(own)
    links = [(a[i], b[j]) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]
    cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
    groups, low = [], 0
    for high in cuts:
        sides = [",".join(str(i) for i, (p, q) in zip(ids, own) if low <= p and q <= high) for ids, own in zip((a, b), spans)]
        groups.append("|".join(sides))
        low = high
    return groups, links


def library(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A.default_vocabulary())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=A.default_pieces())
    return [e.ids for e in first.encode_batch([" " + t for t in texts], add_special_tokens=False)], second.encode(texts)


def brute(rows, both):
    """Every column of every (doc_id, text), by the libraries and plain Python."""
    ids_a, ids_b = library([t or "" for _, t in rows])
    found, counts = [], Counter()
    for (doc_id, text), a, b in zip(rows, ids_a, ids_b):
        raw = (" " + (text or "")).encode()
        whole = b"".join(both.bytes_a[i] for i in a) == raw == b"".join(both.bytes_b[i] for i in b)
        if not text or not whole:
            found.append((doc_id, 0, 0, [], []))
            continue
        groups, links = walk(a, b, both.sizes_a.tolist(), both.sizes_b.tolist())
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return sorted(
        ((d, na, nb, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
         for d, na, nb, g, x in found), key=str
    )


TEXTS = [
    "The cat sat.", "It's  two   spaces", "naïve café, 日本語のテキスト 12345", "<|endoftext|> and <s> here", "\t tab\nand line\r\n", " lead", "x" * 300, "é 🙂 ▁ \x00", None, "", "The cat sat.",
    "unbelievable antidisestablishmentarianism " * 20,
]


def test_equal_to_brute_force(spark, both):
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, slice int, links string, n long")
    got = sorted((tuple(r) for r in A.aligned(docs.repartition(3)).collect()), key=str)
    assert got == brute(rows, both)
    assert got[0][7] != EMPTY


def test_whole_table(spark, both, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500 or text is null").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in A.aligned(docs).collect()), key=str) == brute(rows, both)


def test_empty_table_and_slices(spark, both, docs, empty, rows):
    assert A.aligned(empty).collect() == []
    want = sorted((tuple(r) for r in A.aligned(docs).collect()), key=str)
    assert len(want) == len(rows)
    assert sorted((tuple(r) for r in A.aligned(docs.repartition(2), slice_bytes=5000).collect()), key=str) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_slices_of_any_text(texts):
    both = A.load(A.default_vocabulary(), A.default_pieces())
    row = both.slice(texts, list(range(len(texts))))
    a, b = both.encode(texts)
    place, times = A._unpack(row["links"])
    at = 0
    for i in range(len(texts)):
        groups, links = walk(a[i].tolist(), b[i].tolist(), both.sizes_a.tolist(), both.sizes_b.tolist())
        assert row["groups_sha256"][i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a[i]) else "")
        own = slice(at, at + int(row["met"][i]))
        pairs = row["pairs"][place[own]]
        assert Counter(links) == {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times[own])}
        assert (row["n_groups"][i], row["n_links"][i]) == (len(groups), len(links))
        at += int(row["met"][i])
    assert np.array_equal(np.bincount(place, times, minlength=len(row["pairs"])), row["times"])
