"""Mixing: rows that are alike, reruns in any partitioning, and columns with the names used inside every stage."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosemill.llm import mixing

ROOT = Path(mixing.__file__).parent


def plan_of(rows):
    """What a mix takes, by brute force: rows in the order of their hashes, one by one until the next brings no gain."""
    taken = Counter()
    for source in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == source]
        total, target = sum(r[5] for r in own), own[0][6]
        repeats = min(int(target // total), 3) if total else 0
        budget, upto = target - repeats * total, 0
        for r in sorted(own, key=lambda r: (r[3], r[4])):
            more = total and upto + r[5] / 2 <= budget and upto < budget and repeats < 3
            upto += r[5]
            taken[r[:3]] += repeats + int(bool(more))
    return taken


def test_equal_to_brute_force(spark):
    rows = [(i % 400, f"{'w ' * (i % 7)}x", "abc"[i % 3] if i % 11 else None) for i in range(900)] + [(5, "same words here", "a")] * 500 + [(5, "same words here", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h, tie = mixing.row_hashes("doc_id", "text", "source")
    want = mixing.mix(df).select("doc_id", "text", "source", h, tie, "size", "target").collect()
    assert len(want) == len(rows)
    expected = plan_of([tuple(r) for r in want])
    for parts in (1, 3, 8):
        got = Counter()
        for r in mixing.mix(df.orderBy(F.rand(parts)).repartition(parts)).collect():
            got[r["doc_id"], r["text"], r["source"]] += r["copies"]
        assert {k: n for k, n in got.items() if n} == {k: n for k, n in expected.items() if n}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_any_column_name(spark, docs, sf_dir, name):
    """A caller's columns may have every name that a stage uses inside."""
    source = "".join(p.read_text() for p in [*ROOT.glob("*.py"), Path(corpus_pipeline.__file__)])
    used = set(re.findall(r'(?:alias|withColumn|withColumnRenamed)\((?:[^()"]*,\s*)?"(\w+)"', source)) | {"repeats", "edge", "mix_source", "copies", "row", "of", "in", "part", "more", "number"}
    base = ("doc_id", "text", "lang", "source", "n_chars")
    names = sorted({u.lower() for u in used} - set(base))
    assert len(names) > 80
    wide = docs.select(*base).select(*base, *[F.lit(n).alias(n) for n in names])
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, wide, sf_dir)
    if name == "encoding":
        assert got.count() == docs.count()
        return
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[n] == n for r in rows for n in names)
