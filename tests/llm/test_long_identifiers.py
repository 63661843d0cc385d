"""Identifiers and contexts of any length and shape, precision of what is discovered, and very many spans in one text."""

import time

from prosemill.llm import pii

SEEDS = [f"please write contact: user{i}@mail.example.com now" for i in range(6)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: [s["value"] for s in r["spans"] if s["kind"] == 4] for r in pii.find_personal_data(df).collect()}, df


def test_long_identifiers_and_words(spark):
    long = ["7c9e6679-7425-40de-944b-e07fc1f90ae7", "9" * 64, "4" + "a1" * 50000, "b" * 200]
    word = "x" * 200
    texts = SEEDS + [f"kept {word}{i % 2}{word} {word}: user{i}@mail.example.com" for i in range(6)]
    texts += [f"please write contact: {v} now" for v in long] + [f"other {word}y: 8812345-7x", f"kept {word}1{word} {word}: 8812345-7x"]
    rows, df = found(spark, texts)
    assert [rows[12 + i] for i in range(4)] == [[v] for v in long] and rows[16] == [] and rows[17] == ["8812345-7x"]
    assert pii.redact(df).where("doc_id = 12").first()["text"] == "please write contact: <id> now"


def test_shapes_that_no_pattern_names(spark):
    """Planted: names, handles and codes right of a learned label, or between learned words. All of them, and nothing else."""
    between = [f"passenger user{i}+x@mail.example.com boarded at noon" for i in range(5)]
    planted = {
        "please write contact: jsmith now": "jsmith", "Please write CONTACT: O'Neil-Müller now": "O'Neil-Müller", "we met; contact: @ann_b, then left": "@ann_b",
        "passenger KX-20-991 boarded at noon": "KX-20-991", "the passenger p_miller boarded late": "p_miller",
    }
    clean = [
        "the passenger left the train", "room 1234567-9 is free", "a note: nothing to see here", "version 2.14.7 boarded up", "write to no one at 10:30",
        "item #77 and item #78 cost 20", "please write now",
    ]
    rows, _ = found(spark, SEEDS + between + list(planted) + clean)
    start = len(SEEDS) + len(between)
    assert [rows[start + i] for i in range(len(planted))] == [[v] for v in planted.values()]
    assert not any(rows[start + len(planted) + i] for i in range(len(clean)))


def test_what_overlaps_a_base_span_is_not_added(spark):
    texts = SEEDS + ["please write contact: a1@b.example now", "please write contact: x1@y now", "please write contact: +1 (974) 555-3436 now"]
    rows, _ = found(spark, texts)
    assert rows[6] == [] and rows[7] == ["x1@y"] and rows[8] == []


def test_very_many_spans_in_one_text(spark):
    many = " ".join(f"contact: u{i}@m{i}.example" for i in range(20000)) + " " + " ".join(f"contact: w{i}" for i in range(10000))
    df = spark.createDataFrame([(1, many), (2, None)], "doc_id long, text string")
    began = time.time()
    row = pii.find_personal_data(df).where("id = 1").first()
    assert len(row["spans"]) == 30000
    assert len(row["base"]) == 20000 and len(row["spans"]) >= 20000
    clean = pii.redact(df).where("doc_id = 1").first()["text"]
    assert clean.count("<email>") == 20000 and clean.startswith("contact: <email> contact: <email> ") and "@" not in clean
    assert clean.endswith("<id>")
    assert time.time() - began < 90
