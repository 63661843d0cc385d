"""Containment by one window against the pairwise definition, on many random cases at once."""

import random

from prosemill.operators.resolve import RANKS, css_class, drop_ignored, resolve_containment

RULES = [*RANKS, "longSentence"]


def pairwise(marks):
    """A mark goes if another one covers it: longer, or the same span with a higher rank or an earlier place."""
    live = [m for m in marks if m[3] not in ("doubled", "longSentence")]

    def beats(a, b):
        (_, f, t, r, s), (_, g, u, q, z) = a, b
        if not (f <= g and t >= u):
            return False
        return (t - f, RANKS[r], -s) > (u - g, RANKS[q], -z)

    return {m for m in marks if m not in live or not any(beats(o, m) for o in live)}


def test_window_equals_pairwise(spark):
    rng = random.Random(0x2F6E2B1)
    rows = []
    for case in range(1500):
        for seq in range(rng.randrange(12)):
            start = rng.randrange(14)
            rows.append((case, start, start + 1 + rng.randrange(14), rng.choice(RULES), seq))
    df = spark.createDataFrame(rows, "doc_id int, `from` int, `to` int, rule string, seq int")
    got = {tuple(r) for r in resolve_containment(df).collect()}
    want = set()
    by_case = {}
    for r in rows:
        by_case.setdefault(r[0], []).append(r)
    for marks in by_case.values():
        want |= pairwise(marks)
    assert got == want


def test_ignored_words_never_touch_marks_without_word(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "doc_id int, word string")
    assert {r[0] for r in drop_ignored(df, ["a"]).collect()} == {2, 3}
    assert drop_ignored(df, []) is df


def test_classes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("longSentence", "strong"), ("passive", "info"), ("adverb", "info"), ("other", "info")], "rule string, severity string")
    assert [r[0] for r in df.select(css_class(F.col("rule"), F.col("severity"))).collect()] == [
        "pl-mark pl-long pl-verylong", "pl-mark pl-passive pl-quiet", "pl-mark pl-adverb", "pl-mark",
    ]


def test_within_rows_equals_pairwise(spark):
    from pyspark.sql import functions as F

    from prosemill.operators.resolve import with_resolved

    rng = random.Random(7)
    cases = {case: [(f := rng.randrange(30), f + 1 + rng.randrange(14), rng.choice(RULES), seq) for seq in range(rng.randrange(12))] for case in range(600)}
    cases[1000] = [(f := rng.randrange(3000), f + 1 + rng.randrange(40), rng.choice(RULES), seq) for seq in range(900)]
    df = spark.createDataFrame(list(cases.items()), "doc_id int, marks array<struct<from:int,to:int,rule:string,seq:int>>")
    got = with_resolved(df).select("doc_id", F.explode("marks").alias("x")).select("doc_id", "x.*").collect()
    want = set().union(*(pairwise([(c, *m) for m in marks]) for c, marks in cases.items()))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_only_reaches_are_run_through(spark, monkeypatch):
    """What is run through a row's marks is copied with each of them, so it holds numbers and no marks; nested marks far apart are told."""
    from prosemill.operators import resolve

    kinds, running = [], resolve.running
    monkeypatch.setattr(resolve, "running", lambda *args: kinds.append(args[-1]) or running(*args))
    marks = [(0, 10_000, "cliche", 0), *((i * 10, i * 10 + 4, "adverb", 1) for i in range(2000)), (15_001, 15_030, "longSentence", 0)]
    df = spark.createDataFrame([(1, marks), (2, marks[1:]), (3, []), (4, marks[:1])], "doc_id int, marks array<struct<from:int,to:int,rule:string,seq:int>>")
    got = {r["doc_id"]: [tuple(m) for m in r["marks"]] for r in resolve.with_resolved(df).collect()}
    assert got == {1: sorted([marks[0], *marks[1001:]]), 2: sorted(marks[1:]), 3: [], 4: marks[:1]}
    assert kinds == ["array<int>"]
