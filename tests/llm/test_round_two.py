"""Letters by category, ids of any type, repeats in the mix, dense buckets, merged sketches and turns without numbers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from prosemill.llm import chat, langid, mixing, simhash, sketch
from prosemill.llm._shared import cut


def test_only_category_l_is_a_letter():
    for text in ("½ ② Ⅷ ²", "123 !!", "_", "", None):
        assert len(langid.ngram_counts(text)[0]) == 0
    assert len(langid.ngram_counts("é")[0]) and len(langid.ngram_counts("日本")[0]) and len(langid.ngram_counts("ª")[0])


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_ids_of_any_type(spark, docs, kind):
    model = langid.train(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert model.languages == ("en", "fr")


def test_equal_rows_are_mixed_one_by_one(spark):
    """400 equal rows in a source with room for a part of them, dealt over partitions in two ways."""
    rows = [(7, "w " * 10, "a") for _ in range(400)] + [(100 + i, "v " * 10, "b") for i in range(1000)] + [(5000 + i, None, "c") for i in range(5)]
    taken = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        mixed = mixing.mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("want"), F.max("copies").alias("most"))
        out = {r["source"]: r for r in mixed.collect()}
        assert abs(out["a"]["got"] - out["a"]["want"]) < 0.05 * out["a"]["want"] and out["c"]["most"] <= 3
        taken.append(out["a"]["got"])
    assert taken[0] == taken[1]


def test_copies_never_exceed_the_bound(spark):
    rows = [(i, "" if i % 2 else "one two", "a") for i in range(50)] + [(100 + i, "x " * 500, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(df).agg(F.max("copies")).first()[0] <= 3


def test_dense_buckets_lose_no_link(spark, monkeypatch):
    """A bucket of many values is split by a second family; the components equal those of all pairs."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([2, 3, 9, 12, 30]))) for _ in range(500)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(simhash, "BLOCK", 8)
    df = spark.createDataFrame([(v, 1) for v in values], "fp long, n long")
    got = {r["fp"]: r["component"] for r in simhash.fingerprint_groups(cut(df)).collect()}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in values if find(v) != v}


def test_second_family_covers_too():
    masks = simhash.covering_masks(stride=7)
    assert masks != simhash.covering_masks() and len(set(masks)) == 31
    rng = random.Random(1)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & differing == 0 for m in masks)


def test_sketches_merge_in_spark(spark):
    """Merged by group, fingerprints equal those of the whole, and the estimates stand against exact sets."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    parts = [(i, " ".join(words[i * 300 : i * 300 + 304]), "ab"[i % 2]) for i in range(10)] + [(10, None, "c"), (11, "", None)]
    df = spark.createDataFrame(parts, "doc_id long, text string, part string").repartition(4)
    prints = sketch.sketches(df).join(df.select("doc_id", "part"), "doc_id")
    got = {r["part"]: r for r in sketch.merged(prints, "part").collect()}
    for part in ("a", "b"):
        whole = sketch.bottom_k(__import__("numpy").concatenate(sketch.text_sketches([t for _, t, p in parts if p == part])))
        assert got[part]["fingerprint"] == sketch.to_text(whole)
        exact = len({tuple(w[i : i + 5]) for _, t, p in parts if p == part for w in [t.split()] for i in range(len(w) - 4)})
        assert abs(got[part]["n_distinct"] / exact - 1) < 0.3
    assert got["c"]["fingerprint"] == got[None]["fingerprint"] == "" and got["c"]["n_distinct"] == 0


def test_edited_likeness_against_exact_sets(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=400))) for i in range(20)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for r in sketch.edited_pairs(df, 3).collect():
        text, after = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 20]
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + after[:half])
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.16
        assert abs(r["kept_by_edited"] - len(a & b) / len(a)) < 0.25 and abs(r["n_distinct"] / len(a) - 1) < 0.3


def test_many_messages_without_a_turn_number(spark):
    rows = [(1, None, i, "message", "assistant" if i % 2 else "user", f"<t{i:04d}\\>") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    assert chat.read_back(df).count() >= 500 / chat.CHUNK_TURNS
    a, b = chat.format_digests(df).first(), chat.format_digests(df, row_bytes=1).first()
    assert a == b and a["n_turns"] == 500 and a["loss_chars"] == 250 * 8
