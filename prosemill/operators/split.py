"""Analysis of documents too large for one row: cut into chunks where no construct but a fence is open, with the fence's state composed.

A document comes as parts (doc_id, part, text) that follow one another, each ending after a line feed but the last. Chunks begin at blank lines
that no span, sentence or phrase can cross. Whether a chunk begins inside a fence is told by the chunks before it: each is a
map from the fence that is open before it to the one after it, and maps are joined in order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions.arrays import running
from prosemill.functions.text import SPACES
from prosemill.operators.mask import CONTEXT, FENCE, STRIP

CHUNK = 1 << 20
#: Characters of parts that are cut before their pieces are passed on.
BATCH = 1 << 20
#: No construct that passes a blank line is longer than this.
REACH = 5100
#: A line that no phrase can pass, before a blank line: its last word and stop are prose, or the whole line is masked and long.
SAFE = re.compile(r"[ \t][A-Za-z]{1,40}[.!?]\n(?=[ \t\r]*+\n[ \t\r\n]*+[^\s\"^])")
#: A line that may close a front matter, in Java's syntax.
_BLANKS = "[" + SPACES.replace("\\n", "") + "]*"
CLOSING = f"{_BLANKS}(?:---|[.]{{3}}){_BLANKS}(?=\n|$)"
OUTSIDE = ""
FRAGMENT = "doc_id long, part long, place int, at long, begins boolean, text string"


def safe_points(text: str, first: bool, size: int) -> list[int]:
    """Places in a part where a chunk may begin, about ``size`` apart. Of a part that is not its document's first, the start is out of sight."""
    points, last = [], 0
    at = max(0, (size if first else max(size, REACH)) - 50)
    while m := SAFE.search(text, at):
        at = end = m.end()
        behind = text[max(0, end - REACH) : end]
        long = end - text.rfind("\n", 0, end - 1) > 24
        if long and end - last >= size and (first or end >= REACH) and "$$" not in behind and "<!--" not in behind:
            points.append(end)
            last = end
            at = end + size - 50
    return points


def fence_after(text: str, opener: str) -> str:
    """The fence that is open after a chunk, from the one before it: quote marks and run, or ``OUTSIDE``."""
    if not opener and "```" not in text and "~~~" not in text:
        return OUTSIDE
    for line in text.split("\n"):
        context = CONTEXT.match(line)
        fence = FENCE.match(line, context.end())
        if opener:
            depth, run = opener.count(">"), opener.lstrip(">")
            if context[1].count(">") < depth and line.strip(STRIP):
                opener = OUTSIDE
            elif fence and fence["run"].startswith(run) and context[1].count(">") == depth and not line[fence.end() :].strip(STRIP):
                opener = OUTSIDE
        elif fence:
            opener = ">" * context[1].count(">") + fence["run"]
    return opener


def _fragments(parts: DataFrame, size: int) -> DataFrame:
    names = ["doc_id", "part", "place", "at", "begins", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, part, start, front, text in zip(*(c.to_pylist() for c in batch.columns)):
                points = [p for p in safe_points(text, start == 0, size) if start + p > front]
                edges = [0, *points, len(text)]
                rows += [(doc_id, part, i, start + a, i > 0, text[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
                held += len(text)
                if held >= BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return parts.select("doc_id", "part", "start", "front", "text").mapInArrow(cut, FRAGMENT)


def chunks(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """``doc_id, chunk, at, text``: pieces of about ``size`` characters that can be analysed one by one, but for fences; see ``fenced``.

    ``at`` is the piece's place in its document. A stretch without a safe place is one piece. Only numbers of parts and pieces meet by document.
    """
    slim = parts.select(
        "doc_id", "part", F.length("text").cast("long").alias("n"), F.substring("text", 1, 3).alias("head"),
        F.regexp_instr("text", F.lit(f"(?:^|\n){CLOSING}")).alias("shuts"), F.regexp_instr(F.substr("text", F.lit(4)), F.lit(f"\n{CLOSING}")).alias("later"),
    )
    order = Window.partitionBy("doc_id").orderBy("part")
    starts = slim.withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A front matter ends at the first closing line after its own first line; nothing before that is cut.
    closing = F.when((F.col("start") == 0) & (F.col("later") > 0), F.col("later") + 6).when((F.col("start") > 0) & (F.col("shuts") > 0), F.col("start") + F.col("shuts") + 5)
    whole = Window.partitionBy("doc_id")
    opens = F.max((F.col("start") == 0) & (F.col("head") == "---")).over(whole)
    placed = starts.withColumn("front", F.when(opens, F.coalesce(F.min(closing).over(whole), F.lit(0))).otherwise(F.lit(0)).cast("long")).select("doc_id", "part", "start", "front")
    found = _fragments(parts.join(placed, ["doc_id", "part"]), size)
    begun = found.groupBy("doc_id", "part").agg(F.count_if("begins").alias("k"))
    before = begun.select("doc_id", "part", F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = found.join(before, ["doc_id", "part"]).withColumn("chunk", F.col("before") + F.col("place"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "place", "text")))
    return numbered.groupBy("doc_id", "chunk").agg(F.min("at").alias("at"), pieces.alias("p")).select("doc_id", "chunk", "at", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the checkpoint folder and read back; stored by the executors where no such folder is set."""
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return rows.persist(StorageLevel.DISK_ONLY)
    path = f"{root.rstrip('/')}/pieces-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _after(texts: pd.Series, openers: pd.Series) -> pd.Series:
    return pd.Series([[fence_after(t, o) for o in own] for t, own in zip(texts, openers)], dtype=object)


def fenced(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``opener``, the fence that is open before each.

    The pieces are kept once. Where no piece of a document leaves a fence open, each begins outside. In the other documents the fences that some piece
    leaves open are few; each piece maps every one of them, and ``OUTSIDE``, to what is open after it. New ones among these are mapped in turn
    until there are none. The maps of a document are joined in order on their own, without texts.
    """
    outside = F.array(F.lit(OUTSIDE))
    kept = _kept(pieces.withColumn("_open", F.element_at(_after("text", outside), 1) != OUTSIDE))
    known = kept.where("_open").select("doc_id").distinct().select("doc_id", outside.alias("openers"))
    pieces = kept.drop("_open")
    if known.isEmpty():
        return pieces.withColumn("opener", F.lit(OUTSIDE))
    while True:
        maps = pieces.join(known, "doc_id").select("doc_id", "chunk", "openers", _after("text", "openers").alias("after"))
        wider = maps.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat("openers", "after"))))).alias("openers"))
        wider = _kept(wider)
        if wider.join(known.withColumnRenamed("openers", "had"), "doc_id").where(F.size("openers") > F.size("had")).isEmpty():
            break
        known = wider
    ordered = maps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "openers", "after"))).alias("m"))

    def then(state, x):
        return F.element_at(x["after"], F.array_position(x["openers"], state).cast("int"))

    states = running(F.col("m"), F.lit(OUTSIDE), then, lambda state, x: F.struct(x["chunk"].alias("chunk"), state.alias("opener")), "array<struct<chunk:bigint,opener:string>>")
    begun = ordered.select("doc_id", F.explode_outer(states).alias("s")).select("doc_id", "s.*")
    return pieces.join(begun, ["doc_id", "chunk"], "left").withColumn("opener", F.coalesce("opener", F.lit(OUTSIDE)))


def split(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows for ``ProseEngine``: doc_id (doc_id, chunk, shift) and text. An open fence is opened again in a line before the piece.

    ``shift`` added to an offset of the piece gives the document's; see ``whole``.
    """
    rows = fenced(chunks(parts, size))
    line = F.when(F.col("opener") == OUTSIDE, "").otherwise(F.concat("opener", F.lit("\n")))
    return rows.select(F.struct("doc_id", "chunk", (F.col("at") - F.length(line)).alias("shift")).alias("doc_id"), F.concat(line, "text").alias("text"))


def whole(found: DataFrame) -> DataFrame:
    """Spans (doc_id, from, to, ...) of pieces as spans of their documents."""
    others = [c for c in found.columns if c not in ("doc_id", "from", "to")]
    return found.select(
        F.col("doc_id.doc_id").alias("doc_id"), *[(F.col(c) + F.col("doc_id.shift")).cast("long").alias(c) for c in ("from", "to")], *others
    )
