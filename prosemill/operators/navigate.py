"""Lookups by cursor and remapping of offsets through edits."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BIN = 64


def _swept(items: DataFrame, cursors: DataFrame, item: Column, at: str, forward: bool, tie: tuple[str, ...], strict: bool) -> DataFrame:
    """Each (doc_id, cursor) once, with ``hit``: the last item at or before it, or the first after it if ``forward``; null if none.

    ``end`` is the document's last item, or its first one if ``forward``; null if it has none.

    Items and cursors of a document are put in one order and run through once, so that 100,000 of either cost a sort and no pairs.
    ``strict`` leaves out items at the cursor itself. Items of one place are told apart by ``tie``.
    """
    own = items.select("doc_id", F.col(at).alias("_at"), item.alias("_item"), F.struct(*tie).alias("_tie"))
    asked = cursors.select("doc_id", "cursor").distinct().select("doc_id", F.col("cursor").alias("_at"), "cursor")
    both = own.unionByName(asked, allowMissingColumns=True)
    is_cursor = F.col("cursor").isNotNull()
    # Backward, a cursor comes after the items at its place unless these do not count; forward all is the other way round.
    order = [F.desc("_at") if forward else F.asc("_at"), F.asc(is_cursor) if not strict else F.desc(is_cursor), F.desc("_tie") if forward else F.asc("_tie")]
    window = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_item", ignorenulls=True)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return both.withColumns({"hit": last.over(window), "end": last.over(whole)}).where(is_cursor).select("doc_id", "cursor", "hit", "end")


def step_mark(marks: DataFrame, cursors: DataFrame, forward: bool = True) -> DataFrame:
    """For each (doc_id, cursor): the next mark after it, else the first; or the last before it, else the last."""
    item = F.struct("from", "to", "rule", "message")
    found = _swept(marks, cursors, item, "from", forward, ("to", "rule"), strict=True).where("doc_id is not null and end is not null")
    return found.select("doc_id", "cursor", F.coalesce("hit", "end").alias("x")).select("doc_id", "cursor", "x.*")


def nth_of_rule(marks: DataFrame, walks: DataFrame) -> DataFrame:
    """For each (doc_id, rule, step): the mark at that step of the rule's marks, counted round."""
    by_rule = Window.partitionBy("doc_id", "rule")
    numbered = marks.select(
        "doc_id", "rule", "from", "to", (F.row_number().over(by_rule.orderBy("from", "to")) - 1).alias("place"), F.count("*").over(by_rule).alias("n")
    )
    return walks.join(numbered, ["doc_id", "rule"]).where(F.col("place") == F.pmod(F.col("step"), F.col("n"))).drop("place", "n")


def sentence_at(sentences: DataFrame, cursors: DataFrame) -> DataFrame:
    """The first sentence that holds each cursor, both ends included. Sentences of a document may touch but do not overlap."""
    item = F.struct("from", "to", "sent_idx")
    before = F.lag(item).over(Window.partitionBy("doc_id").orderBy("from", "to"))
    paired = sentences.select("doc_id", "from", "to", "sent_idx", before.alias("before"))
    found = _swept(paired, cursors, F.struct(item.alias("own"), "before"), "from", False, ("to", "sent_idx"), strict=False)
    held = F.when(F.col("hit.before.to") >= F.col("cursor"), F.col("hit.before")).when(F.col("hit.own.to") >= F.col("cursor"), F.col("hit.own"))
    return found.select("doc_id", "cursor", held.alias("x")).where("x is not null").select("doc_id", "cursor", "x.*")


def mark_of_word(marks: DataFrame, lookups: DataFrame) -> DataFrame:
    """Marks of a word around a cursor: (doc_id, cursor, word).

    A mark lies in the few bins of ``BIN`` characters that it touches, so a cursor only meets marks near by.
    """
    binned = marks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from") / BIN), F.floor(F.col("to") / BIN))))
    asked = lookups.withColumn("_bin", F.floor(F.col("cursor") / BIN))
    return asked.join(binned, ["doc_id", "word", "_bin"]).where("cursor between `from` and `to`").drop("_bin")


def focus_ranges(sentences: DataFrame, cursors: DataFrame, lengths: DataFrame) -> DataFrame:
    """Up to two ranges to dim: before and after the sentence under the cursor."""
    both = sentence_at(sentences, cursors).join(lengths, "doc_id")
    a, b = F.least("from", "length"), F.least("to", "length")
    ranges = F.array(
        F.when(a > 0, F.struct(F.lit(0).alias("from"), a.alias("to"))),
        F.when(b < F.col("length"), F.struct(b.alias("from"), F.col("length").cast("int").alias("to"))),
    )
    return both.select("doc_id", "cursor", F.array_compact(ranges).alias("ranges"))


def map_offset(offset: Column, edits: Column, bias: int) -> Column:
    """An offset moved through ordered edits (from, to, insert): bias -1 stays before inserted text, 1 goes after it."""

    def step(at: Column, e: Column) -> Column:
        shift = e["insert"] - (e["to"] - e["from"])
        before = (at < e["from"]) | ((at == e["from"]) & ((e["to"] > e["from"]) | F.lit(bias < 0)))
        inside = at < e["to"]
        edge = e["from"] if bias < 0 else e["from"] + e["insert"]
        return F.when(before, at).when(inside, edge).otherwise(at + shift)

    return F.aggregate(edits, offset.cast("int"), step)


EDITED = "doc_id long, part long, side int, starts array<long>, values array<long>, moves array<boolean>"
PART = 256
#: Pieces of two maps together up to which plain lists are faster than arrays.
SHORT = 48


def _edit(low: int, high: int, insert: int, side: int) -> tuple[list[int], list[int], list[bool]]:
    """One edit as a map of offsets: from each start on, offsets move along from a value or stay at it. ``side`` as in ``map_offset``."""
    inside = low if side < 0 else low + insert
    if low == high:
        first = low + (side < 0)
        pieces = [(0, 0, True), (first, first + insert, True)]
    else:
        pieces = [(0, 0, True), (low + 1, inside, False), (high, low + insert, True)]
    last = {start: (value, moves) for start, value, moves in pieces}  # an empty piece gives way to the next one
    starts = sorted(last)
    return starts, [last[x][0] for x in starts], [last[x][1] for x in starts]


def _compose_short(first: tuple, then: tuple) -> tuple[list[int], list[int], list[bool]]:
    """``compose`` for maps of a few pieces, which are most of those in a tree."""
    (p, v, m), (q, w, n) = first, then
    starts, values, moves = [], [], []
    for i, (start, value, along) in enumerate(zip(p, v, m)):
        k = bisect_right(q, value)
        starts.append(start)
        values.append(w[k - 1] + (value - q[k - 1] if n[k - 1] else 0))
        moves.append(along and n[k - 1])
        if along:
            end = value + p[i + 1] - start if i + 1 < len(p) else 1 << 62
            while k < len(q) and q[k] < end:
                starts.append(start + q[k] - value)
                values.append(w[k])
                moves.append(n[k])
                k += 1
    return starts, values, moves


def compose(first: tuple, then: tuple) -> tuple:
    """The map that applies ``first`` and ``then``: associative, so that maps of an edit log can be joined in any grouping.

    Where ``first`` moves along, the starts of ``then`` that its values pass are starts of the whole as well.
    """
    if isinstance(first[0], list) and isinstance(then[0], list) and len(first[0]) + len(then[0]) <= SHORT:
        return _compose_short(first, then)
    (p, v, m), (q, w, n) = (tuple(map(np.asarray, x)) for x in (first, then))
    ends = v + np.append(np.diff(p), 1 << 62)
    low, high = np.searchsorted(q, v, "right"), np.searchsorted(q, ends, "left")
    count = np.where(m, np.maximum(high - low, 0), 0)
    piece = np.repeat(np.arange(len(p)), count)
    passed = q[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    starts = np.concatenate((p, p[piece] + passed - v[piece]))
    values, moves = np.concatenate((v, passed)), np.concatenate((m, m[piece]))
    order = np.argsort(starts, kind="stable")
    starts, values, moves = starts[order], values[order], moves[order]
    at = np.searchsorted(q, values, "right") - 1
    return starts, w[at] + np.where(n[at], values - q[at], 0), moves & n[at]


def composed(edits: DataFrame) -> DataFrame:
    """Edit logs (doc_id, seq, from, to, insert) as one map for each document and side: ``doc_id, side, start, value, moves``, a row for each piece.

    Edits follow one another in ``seq``, from 0, each in the offsets that the one before leaves. They are composed in a tree: parts of ``PART``
    edits, then parts of parts, so no task folds a whole log one by one and only maps move on.
    """

    def fold(maps: list[tuple]) -> tuple:
        while len(maps) > 1:
            maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    columns = ["doc_id", "part", "side", "starts", "values", "moves"]

    def row(doc_id: int, part: int, side: int, x: tuple) -> tuple:
        return doc_id, part, side, *(c if isinstance(c, list) else c.tolist() for c in x)

    def leaves(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                logs = ((doc_id, part, list(zip(*(x.tolist() for x in edit)))) for doc_id, part, *edit in frame.iloc[at : at + 500].itertuples(index=False))
                yield pd.DataFrame([row(doc_id, part, side, fold([_edit(*e, side) for e in log])) for doc_id, part, log in logs for side in (-1, 1)], columns=columns)

    def parents(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("part")
        whole = fold([(r.starts, r.values_, r.moves) for r in ordered.rename(columns={"values": "values_"}).itertuples()])
        return pd.DataFrame([row(*key, whole)], columns=columns)

    # A part's edits, at most PART, meet in one row, so that a batch of many parts is one call.
    own = F.array_sort(F.collect_list(F.struct("seq", "from", "to", "insert")))
    logs = edits.groupBy("doc_id", F.floor(F.col("seq") / PART).alias("part")).agg(own.alias("e"))
    parts = logs.select("doc_id", "part", *[F.transform("e", lambda x: x[c].cast("long")).alias(c) for c in ("from", "to", "insert")]).mapInPandas(leaves, EDITED)
    most = edits.agg(F.max("seq")).first()[0] or 0
    tiers = 0
    while most // PART >> 4 * tiers:
        parts = parts.withColumn("part", F.floor(F.col("part") / 16)).groupBy("doc_id", "part", "side").applyInPandas(parents, EDITED)
        tiers += 1
    pieces = F.arrays_zip(F.col("starts").alias("start"), F.col("values").alias("value"), "moves")
    return parts.select("doc_id", "side", F.explode(pieces).alias("x")).select("doc_id", "side", "x.*")


def remap(maps: DataFrame, offsets: DataFrame, side: int) -> DataFrame:
    """``doc_id, offset, moved``: offsets through their document's map, by one sweep; those of documents without edits stay."""
    own = maps.where(F.col("side") == side).select("doc_id", F.col("start").alias("from"), "value", "moves")
    found = _swept(own, offsets.withColumnRenamed("offset", "cursor"), F.struct("from", "value", "moves"), "from", False, ("value",), strict=False)
    moved = F.col("hit.value") + F.when(F.col("hit.moves"), F.col("cursor") - F.col("hit.from")).otherwise(0)
    return found.select("doc_id", F.col("cursor").alias("offset"), F.coalesce(moved, F.col("cursor")).cast("long").alias("moved"))


def remap_sides(maps: DataFrame, offsets: DataFrame) -> DataFrame:
    """``doc_id, offset, to_left, to_right``: both sides of ``remap`` from one reading of the maps."""
    sides = {-1: "to_left", 1: "to_right"}
    keyed = maps.withColumn("doc_id", F.struct("doc_id", "side")).withColumn("side", F.lit(0))
    asked = offsets.select("doc_id", "offset", F.explode(F.array(*map(F.lit, sides))).alias("side")).select(F.struct("doc_id", "side").alias("doc_id"), "offset")
    found = remap(keyed, asked, 0).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.side").alias("side"), "offset", "moved")
    return found.groupBy("doc_id", "offset").agg(*[F.max(F.when(F.col("side") == side, F.col("moved"))).alias(name) for side, name in sides.items()])


def reveal(offset: Column, length: Column) -> Column:
    """An offset clamped to the document; null if negative."""
    return F.when(offset >= 0, F.least(offset, length))
