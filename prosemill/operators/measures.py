"""Readability statistics, rhythm, echoes and revision deltas."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.arrays import each
from prosemill.functions.text import band, bar_width, clamp, ease_label, round1, sane_count

# The compared metrics in order, their labels, and whether more is better (1), worse (-1) or neither.
METRICS = (
    ("words", "Words", 0),
    ("grade", "Grade level", -1),
    ("flesch", "Reading ease", 1),
    ("avgSentenceWords", "Avg sentence length", -1),
    ("passive", "Passive voice", -1),
    ("hedge", "Hedges", -1),
    ("adverb", "Adverbs", -1),
    ("weasel", "Weasel words", -1),
    ("cliche", "Cliches", -1),
    ("deslop", "Machine-prose marks", -1),
    ("longSentence", "Long sentences", -1),
)
FLAT = ("words", "grade", "flesch", "avgSentenceWords")


READABILITY_FIELDS = ("words", "syllables")
SCORES = ("words", "sentences", "syllables", "flesch", "grade", "avgSentenceWords", "longestSentenceWords", "ease")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def readability(scanned: DataFrame) -> DataFrame:
    """``doc_id`` and ``SCORES`` of each document, from the words and syllables of its sentences, within its row.

    A document without words has zeros everywhere, its sentences included.
    """
    sums = scanned.select(
        *[c for c in scanned.columns if c not in ("words", "syllables")],
        _sum(F.col("words")).alias("w"), F.size("words").alias("n"), _sum(F.col("syllables")).alias("syl"), F.array_max("words").alias("longest"),
    )
    spoken = F.col("w") > 0

    def kept(x: Column) -> Column:
        return F.when(spoken, x).otherwise(0)

    per_sentence, per_word = F.try_divide("w", "n"), F.try_divide("syl", "w")
    flesch = clamp(206.835 - 1.015 * per_sentence - 84.6 * per_word, 0.0, 100.0)
    grade = F.greatest(0.39 * per_sentence + 11.8 * per_word - 15.59, F.lit(0.0))
    scores = {
        "words": kept(F.col("w")).cast("long"),
        "sentences": kept(F.col("n")).cast("long"),
        "syllables": kept(F.col("syl")).cast("long"),
        "flesch": round1(kept(flesch)),
        "grade": round1(kept(grade)),
        "avgSentenceWords": round1(kept(per_sentence)),
        "longestSentenceWords": kept(F.col("longest")).cast("long"),
    }
    others = [c for c in sums.columns if c not in ("w", "n", "syl", "longest")]
    return sums.select(*others, *[x.alias(c) for c, x in scores.items()]).withColumn("ease", ease_label(F.col("flesch")))


@dataclass(frozen=True)
class RhythmOptions:
    short_max: float = 8
    long_min: float = 25
    very_long_min: float = 40
    run: float = 4
    spread: float = 3

    @classmethod
    def of(cls, **given) -> RhythmOptions:
        """Options from what is given; what is not a finite number is ignored."""
        numbers = {k: v for k, v in given.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}
        o = cls(**numbers)
        return cls(o.short_max, o.long_min, o.very_long_min, max(2, math.floor(o.run)), max(0, o.spread))


def monotone_runs(lengths: list[int], run: int = 4, spread: float = 3) -> list[dict[str, int]]:
    """Runs of similar lengths, longest from the left; the search goes on after a run, else one place later.

    Deques of the window's minima and maxima move with both ends, so the whole is linear.
    """
    from collections import deque

    low, high, end, start, found = deque(), deque(), 0, 0, []
    n = len(lengths)
    while start < n:
        end = max(end, start)
        while end < n:
            x = lengths[end]
            least = min(x, lengths[low[0]]) if low else x
            most = max(x, lengths[high[0]]) if high else x
            if most - least > spread:
                break
            while low and lengths[low[-1]] >= x:
                low.pop()
            while high and lengths[high[-1]] <= x:
                high.pop()
            low.append(end)
            high.append(end)
            end += 1
        if end - start >= run:
            found.append({"fromIndex": start, "toIndex": end - 1, "length": end - start})
            start = end
        else:
            start += 1
        for window in (low, high):
            while window and window[0] < start:
                window.popleft()
    return found


def rhythm(documents: DataFrame, sentences: DataFrame, options: RhythmOptions = RhythmOptions()) -> DataFrame:
    """The rhythm of documents whose sentences (doc_id, sent_idx, words) are rows."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "words"))), lambda s: s["words"])
    grouped = sentences.groupBy("doc_id").agg(ordered.alias("words"))
    return rhythm_of(documents.select("doc_id").join(grouped, "doc_id", "left"), options)


def rhythm_of(scanned: DataFrame, options: RhythmOptions = RhythmOptions()) -> DataFrame:
    """Lengths, bands, monotone runs and variety of each document's sentences, from ``words``, the array of their lengths.

    All are of the same counts: null and negative ones are 0. A null array is empty.
    """
    run, spread = int(options.run), options.spread

    @F.pandas_udf("array<struct<fromIndex:int,toIndex:int,length:int>>")
    def runs(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: monotone_runs([] if x is None else list(x), run, spread))

    sane = F.transform(F.coalesce("words", F.array().cast("array<int>")), sane_count)
    full = scanned.select("doc_id", sane.alias("lengths")).withColumn("mean", F.try_divide(_sum(F.col("lengths")), F.size("lengths")))
    named = F.transform("lengths", lambda w: band(w, options.short_max, options.long_min, options.very_long_min))
    squares = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return full.select(
        "doc_id",
        "lengths",
        named.alias("bands"),
        runs("lengths").alias("monotoneRuns"),
        F.when(F.size("lengths") >= 2, round1(F.sqrt(F.try_divide(squares, F.size("lengths"))))).otherwise(0.0).alias("variety"),
    )


def flat_sentences(rhythms: DataFrame) -> DataFrame:
    """How many monotone runs a document has and how many sentences they hold."""
    total = F.aggregate("monotoneRuns", F.lit(0), lambda a, r: a + r["length"])
    return rhythms.select("doc_id", F.size("monotoneRuns").alias("runs"), total.alias("flatSentences"))


BAND_FIELDS = ("sent_from", "sent_to", "words")


def bands(scanned: DataFrame, options: RhythmOptions = RhythmOptions()) -> DataFrame:
    """Band, class and bar width of every sentence; the longest one is found in the document's row."""
    items = F.arrays_zip(F.col("sent_from").alias("from"), F.col("sent_to").alias("to"), "words")
    rows = scanned.select("doc_id", F.array_max("words").alias("longest"), items.alias("items"))
    name = band(F.col("words"), options.short_max, options.long_min, options.very_long_min)
    return each(rows, ["doc_id", "longest"], "items", "sent_idx").select(
        "doc_id", "sent_idx", "from", "to", "words", name.alias("band"),
        F.concat(F.lit("pl-heat pl-heat-"), F.lower(name)).alias("css_class"), bar_width(F.col("words"), F.col("longest")).alias("bar_width"),
    )


@dataclass(frozen=True)
class EchoOptions:
    window: int = 4
    min_count: int = 3
    min_length: int = 4
    most: int = 25

    @classmethod
    def of(cls, **given) -> EchoOptions:
        """Options from what is given; a value that is not finite or too small gives the default."""
        least = {"window": 1, "min_count": 3, "min_length": 2, "most": 0}
        ok = {}
        for k, v in given.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and math.floor(v) >= least[k]:
                ok[k] = math.floor(v)
        return cls(**ok)


def echoes(scanned: DataFrame, options: EchoOptions = EchoOptions()) -> DataFrame:
    """Words and word pairs repeated within a few sentences: doc_id, term, kind, count, offsets.

    A scan's ``terms`` are those whose count over some window of sentences reaches the least count. Proper nouns (always
    capitalised inside sentences) and pairs that land exactly on a repeated word are left out; the most frequent ``most`` terms
    of each document stay. All in the document's row: nothing is shuffled.
    """
    own = F.filter("terms", lambda t: ~t["proper"] & ~t["doubles"])
    ranked = F.sort_array(F.transform(own, lambda t: F.struct((-t["count"]).alias("order"), t["term"].alias("term"), t["kind"].alias("kind"), t["offsets"].alias("offsets"))))
    rows = each(scanned, ["doc_id"], F.slice(ranked, 1, options.most))
    return rows.select("doc_id", "term", "kind", (-F.col("order")).alias("count"), "offsets")


def snapshot(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """The compared numbers of each document, one column for each metric, from its scores and its counts by rule as rows."""
    rules = [k for k, _, _ in METRICS if k not in FLAT]
    wide = counts.groupBy("doc_id").agg(*[F.sum(F.when(F.col("rule") == r, F.col("n")).otherwise(0)).alias(r) for r in rules])
    return snapshot_of(stats.join(wide, "doc_id", "left"))


def snapshot_of(wide: DataFrame) -> DataFrame:
    """The same from one row for each document; missing and non-finite numbers are 0."""

    def finite(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0).alias(name)

    return wide.select("doc_id", *[finite(k) for k, _, _ in METRICS])


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """The metrics of two snapshots side by side: doc_id, ord, key, label, before, after, delta, better."""
    sides = [df.withColumn("side", F.lit(side)) for side, df in (("before", before), ("after", after))]
    return side_delta(sides[0].unionByName(sides[1]))


def side_delta(snapshots: DataFrame) -> DataFrame:
    """The same from one table with a ``side`` column (before, after), in one grouping; documents with one side are left out."""
    item = F.struct(*[k for k, _, _ in METRICS])
    ends = snapshots.groupBy("doc_id").agg(*[F.max(F.when(F.col("side") == side, item)).alias(side) for side in ("before", "after")])
    return change_rows(ends.where("before is not null and after is not null"), ["doc_id"])


def change_rows(ends: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each metric from rows with ``before`` and ``after``, structs of the compared numbers, and these keys."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(sign).alias("sign"),
                F.col("before")[k].alias("before"), F.col("after")[k].alias("after"),
            )
            for i, (k, label, sign) in enumerate(METRICS)
        ]
    )
    both = ends.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    change = round1(F.col("after") - F.col("before"))
    moved = F.when((F.col("sign") != 0) & (F.col("delta") != 0), F.signum("delta") == F.col("sign"))
    return both.withColumn("delta", F.when(change == 0, 0.0).otherwise(change)).select(
        *keys, "ord", "key", "label", "before", "after", "delta", moved.alias("better")
    )


def has_moved(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("doc_id").agg(F.bool_or(F.col("delta") != 0).alias("moved"))


def legend(counted: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Count of every enabled rule for every document, zeros included, with the document's total.

    ``counted`` has one row for each document with a column of counts for each rule.
    """
    shown = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule"), F.lit(n).alias("name"), F.col(r).cast("long").alias("n")) for i, (r, n) in enumerate(rules)])
    total = sum((F.col(r) for r, _ in rules), F.lit(0)).cast("long")
    return each(counted.select("doc_id", shown.alias("shown"), total.alias("total")), ["doc_id", "total"], "shown").select("doc_id", "ord", "rule", "name", "n", "total")


#: Size of the quantile sketch: the rank of a quantile is within about 1.7 % (for k = 200, with 99 % probability).
KLL_K, HLL_BITS = 200, 12
QUANTILES = (0.1, 0.5, 0.9)


def sketched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, sentences, q10, q50, q90 and vocabulary of each group of ``keys``, of each prefix of them, and of all rows.

    ``rows`` have ``words``, the lengths of a document's sentences, and ``lower``, its words. Sketches are made once for each group, and those of
    larger groups are unions of them. Keys of a larger group are null there; ``level`` tells how many are given.
    """
    lengths = rows.select(*keys, F.explode("words").alias("n"))
    heard = rows.select(*keys, F.explode("lower").alias("word"))
    quantiles = lengths.groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col("n").cast("long"), KLL_K).alias("kll"), F.count("*").alias("sentences"))
    vocabulary = heard.groupBy(*keys).agg(F.hll_sketch_agg("word", HLL_BITS).alias("hll"))
    same = [F.col(f"q.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    base = quantiles.alias("q").join(vocabulary.alias("v"), reduce(Column.__and__, same), "left").select(*[f"q.{k}" for k in keys], "kll", "sentences", "hll")
    level = sum((1 - F.grouping(k) for k in keys), F.lit(0)).cast("int")
    found = base.rollup(*keys).agg(
        F.kll_merge_agg_bigint("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"), F.sum("sentences").alias("sentences"), level.alias("level")
    )
    named = [F.kll_sketch_get_quantile_bigint("kll", F.lit(q)).alias(f"q{round(100 * q)}") for q in QUANTILES]
    return found.select(*keys, "level", "sentences", *named, F.hll_sketch_estimate("hll").alias("vocabulary"))
