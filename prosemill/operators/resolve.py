"""From candidate marks to marks: ignore list, containment, order and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.arrays import positions, running

# Precedence of marks on the same span.
RANKS = {"doubled": 70, "deslop": 60, "cliche": 50, "passive": 40, "hedge": 30, "weasel": 25, "adverb": 10}


def drop_ignored(marks: DataFrame, words: list[str]) -> DataFrame:
    """Without marks whose word is ignored; marks without a word always stay."""
    if not words:
        return marks
    ignored = marks.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return marks.join(ignored, "word", "left_anti").select(*marks.columns)


def rank(rule: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for r in RANKS.items() for x in r])[rule], F.lit(0))


def resolve_containment(marks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Without marks that lie inside another one.

    In order of start, longest first, then rank, a mark is inside an earlier one exactly if some earlier one
    reaches as far: a running maximum in one window. Long sentences and doubled words neither drop nor are dropped;
    partial overlaps stay, and so do rows without a rule.
    """
    layered = F.col("rule").isNotNull() & ~F.col("rule").isin("longSentence", "doubled")
    order = (
        Window.partitionBy(*keys)
        .orderBy("from", F.desc("to"), F.desc(rank(F.col("rule"))), "seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.coalesce(F.max(F.when(layered, F.col("to"))).over(order), F.lit(-1))
    return marks.withColumn("_reach", reach).where(~layered | (F.col("to") > F.col("_reach"))).drop("_reach")


def without_ignored(marks: Column, words: list[str]) -> Column:
    """An array of marks without those whose word is ignored."""
    return F.filter(marks, lambda m: m["word"].isNull() | ~m["word"].isin(words)) if words else marks


def with_resolved(rows: DataFrame, name: str = "marks") -> DataFrame:
    """``resolve_containment`` within each row, on its array of marks: sorted, then run through once with the reach so far.

    Where each mark reaches beyond the one before it, none is inside another. Only reaches are run through, not the marks.
    """

    def keyed(m: Column) -> Column:
        layered = ~m["rule"].isin("longSentence", "doubled")
        order = reduce(lambda w, x: w.when(m["rule"] == x[0], -x[1]), RANKS.items(), F.when(F.lit(False), 0)).otherwise(0)
        return F.struct(m["from"].alias("from"), (-m["to"]).alias("end"), order.alias("order"), m["seq"].alias("seq"), layered.alias("layered"), m.alias("mark"))

    def step(reach: Column, x: Column) -> Column:
        return F.when(x["layered"], F.greatest(reach, -x["end"])).otherwise(reach)

    def kept(x: Column, reach: Column) -> Column:
        return F.when(~x["layered"] | (-x["end"] > reach), x["mark"])

    ordered = rows.withColumn("_ordered", F.sort_array(F.transform(name, keyed)))
    ordered = ordered.withColumn("_ends", F.transform(F.filter("_ordered", lambda x: x["layered"]), lambda x: x["end"]))
    inside = F.exists(positions(F.col("_ends"), 1), lambda k: F.get(F.col("_ends"), k) >= F.get(F.col("_ends"), k - 1))
    reaches = running(F.col("_ordered"), F.lit(-1), step, lambda reach, x: reach, "array<int>")
    found = F.filter(F.zip_with("_ordered", reaches, kept), lambda m: m.isNotNull())
    return ordered.withColumn(name, F.when(inside, found).otherwise(F.transform("_ordered", lambda x: x["mark"]))).drop("_ordered", "_ends")


def counts_by_rule(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def css_class(rule: Column, severity: Column) -> Column:
    """Class of a painted mark."""
    from prosemill.plans.options import RULES

    base = F.coalesce(F.create_map(*[F.lit(x) for r, (_, c) in RULES.items() for x in (r, c)])[rule], F.lit("pl-mark"))
    return F.concat(
        base,
        F.when((rule == "longSentence") & (severity == "strong"), " pl-verylong")
        .when((rule == "passive") & (severity == "info"), " pl-quiet")
        .otherwise(""),
    )
