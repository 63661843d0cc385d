import pytest
from pyspark.sql import functions as F

from prosemill.functions import lexicons as L
from prosemill.functions import text as X

SYLLABLES = {
    "the": 1, "axe": 1, "make": 1, "makes": 1, "table": 2, "tables": 2, "walked": 1, "wanted": 2, "yellow": 2, "rhythm": 1, "queue": 1,
    "readability": 5, "": 0, "é": 0, "don't": 1,
}


def test_syllables(spark):
    df = spark.createDataFrame([(w, n) for w, n in SYLLABLES.items()], "w string, n int")
    assert df.where(X.syllables(F.col("w")) != F.col("n")).collect() == []


def test_round1_ties_go_up(spark):
    rows = spark.createDataFrame([(-2.25,), (2.25,), (None,), (float("nan"),), (0.04,)], "x double")
    assert [r[0] for r in rows.select(X.round1(F.col("x"))).collect()] == [-2.2, 2.3, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("line", "at", "word"),
    [("a world's end", 4, "world's"), ("co-operate", 3, "co-operate"), ("12 3", 1, None), ("'hi'", 2, "hi"), ("abc", 99, "abc"), ("", 0, None), ("abc", -1, None)],
)
def test_word_at(spark, line, at, word):
    df = spark.createDataFrame([(line, at)], "line string, at int")
    assert df.select(X.word_at(F.col("line"), F.col("at"))).first()[0] == word


def test_small_formats(spark):
    row = spark.range(1).select(
        X.signed(F.lit(1.5)), X.signed(F.lit(-2.0)), X.signed(F.lit(3.0)), X.singular(F.lit("Weasel words")),
        X.status_text(F.lit(7.7), F.lit(61.0), F.lit(10)), X.bar_width(F.lit(1), F.lit(100)), X.bar_width(F.lit(5), F.lit(8)),
        X.web_url(F.lit("javascript:x"), "f"), X.web_url(F.lit("https://a.b/c"), "f"), X.utf16_offset(F.lit("a🎯b"), F.lit(2)),
        X.skip_text(F.lit("too-large"), F.lit(300001), F.lit(300000)), X.base_form(F.lit("they’re")), X.ease_label(F.lit(50.0)),
    ).first()
    assert list(row) == [
        "+1.5", "-2", "+3", "Weasel word", "Grade 7.7 · Easy", 4, 63, "f", "https://a.b/c", 3,
        "This note is too large for live analysis (300,001 characters, limit 300,000). Raise the limit in settings, under Performance.",
        "they", "Fairly hard",
    ]


def test_lists_are_clean():
    lists = [L.WEASELS, L.HEDGES, L.HEDGE_PHRASES, L.CLICHES, L.NOT_ADVERBS, L.IRREGULAR_PARTICIPLES, L.NOT_PARTICIPLES, L.MACHINE_WORDS, L.MACHINE_PHRASES, L.STOPWORDS]
    assert [len(x) for x in lists] == [38, 50, 27, 44, 93, 140, 50, 76, 46, 139]
    for words in lists:
        assert len(set(words)) == len(words) and all(w == w.lower().strip() for w in words)
    assert not set(L.WEASELS) & set(L.HEDGES)
    assert not set(L.IRREGULAR_PARTICIPLES) & set(L.NOT_PARTICIPLES)


def test_lists_that_must_not_overlap():
    """A word with two rules, or a phrase with two meanings, would be marked by list order alone."""
    for a, b in ((L.WEASELS, L.HEDGES), (L.HEDGE_PHRASES, L.CLICHES), (L.MACHINE_WORDS, L.MACHINE_PHRASES), (L.BE_FORMS, L.GET_FORMS)):
        assert set(a).isdisjoint(b)
    assert set(L.NOT_ADVERBS).isdisjoint(L.WEASELS)
