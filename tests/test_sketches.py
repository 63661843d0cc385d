"""Sketches of groups against exact quantiles and numbers of words, and their unions against sketches of the whole."""

import random

import pytest

from prosemill.operators import measures as M


@pytest.mark.parametrize("skew", [1, 3])
def test_sketches_are_within_their_bounds(spark, skew):
    rng = random.Random(skew)
    docs = [("ab"[i % 2], f"s{i % 5}", [int(rng.random() ** skew * 500) for _ in range(40)], [f"w{int(rng.random() ** skew * 9000)}" for _ in range(200)]) for i in range(600)]
    frame = spark.createDataFrame(docs, "lang string, source string, words array<int>, lower array<string>")
    rows = M.sketched(frame, ["lang", "source"]).collect()
    assert sorted(r["level"] for r in rows) == [0] + [1] * 2 + [2] * 10
    for r in rows:
        own = [d for d in docs if r["level"] == 0 or (d[0] == r["lang"] and (r["level"] == 1 or d[1] == r["source"]))]
        lengths, words = sorted(n for d in own for n in d[2]), {w for d in own for w in d[3]}
        assert r["sentences"] == len(lengths)
        for q in M.QUANTILES:
            value = r[f"q{round(100 * q)}"]
            low, high = sum(n < value for n in lengths) / len(lengths), sum(n <= value for n in lengths) / len(lengths)
            assert low - 0.02 <= q <= high + 0.02
        assert abs(r["vocabulary"] - len(words)) <= 0.05 * len(words)


def test_null_groups_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "s", [3, 4], ["a"]), ("x", None, [], [])], "lang string, source string, words array<int>, lower array<string>")
    assert {(r["lang"], r["source"], r["level"], r["sentences"]) for r in M.sketched(frame, ["lang", "source"]).collect()} == {(None, "s", 2, 2), (None, None, 1, 2), (None, None, 0, 2)}
    assert M.sketched(frame.limit(0), ["lang", "source"]).where("level > 0").count() == 0
