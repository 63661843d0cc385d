"""Mixing sources to target weights by nested hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hashes(id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """A hash of LEVELS * LEVEL_BITS bits and a second one of 64, which depend on the row's id, text and source alone, so that reruns agree.

    Together they order rows totally, but for rows that are alike in all three.
    """
    values = [F.col(c) for c in (id_col, text_col, source_col)]
    told = [*values, *[v.isNull() for v in values]]
    return F.pmod(F.xxhash64(*told, F.lit("mix")), F.lit(1 << (LEVELS * LEVEL_BITS))), F.xxhash64(*told, F.lit("tie"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each source, from one row for each with ``source`` and ``source_size``.

    Sources in code point order, null last, weigh ``weights``, repeating, and share all words. A target stops
    at ``max_repeats`` times its source's size and the excess goes to the others by weight. With sources sorted
    by cap / weight the capped ones come first, so the final share for each unit of weight is the largest value of
    (total - caps before) / (weight not before). The window holds one row for each source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("share", share)
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("share").over(whole)))
        .select("source", "source_size", "target")
    )


def plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """For each source: its size and target, whole repeats of every row, and up to which row rows are taken once more.

    ``slim`` has source, size, h and tie. Words are summed by source and bucket of the hash's highest bits; running
    sums find the bucket in which the budget ends, and only that bucket's rows are summed again by the next bits, those of the
    last value by ``tie``. Rows before (edge, edge_tie) are taken, and ``edge_taken`` of the ``edge_rows`` alike there: as many as bring
    the sum nearest to the target.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = cut(
        targets(sizes, weights, max_repeats)
        .withColumn(
            "repeats",
            F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats)))
            .otherwise(0)
            .cast("long"),
        )
        .withColumn("budget", F.greatest(F.col("target") - F.col("repeats") * F.col("source_size"), F.lit(0.0)))
    )
    state = budgets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 2):
        shift = (LEVELS - level) * LEVEL_BITS
        last = level > LEVELS
        bucket = F.col("tie") if last else F.shiftright(F.col("h"), shift)
        own = F.col("h") if last else F.shiftright(F.col("h"), shift + LEVEL_BITS)
        inside = F.col("source").eqNullSafe(F.col("s")) & (own == F.col("prefix"))
        sums = slim.join(state, inside).groupBy("s", "prefix", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        running = Window.partitionBy("s").orderBy("bucket")
        crossed = (
            sums.withColumn("upto", F.sum("words").over(running))
            .where(F.col("upto") > F.col("budget"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "upto", "words", "budget", "n", "prefix")).alias("x"))
        )
        left = F.col("x.budget") - F.col("x.upto") + F.col("x.words")
        state = cut(crossed.select("s", left.alias("budget"), F.col(f"x.{'prefix' if last else 'bucket'}").alias("prefix"), F.col("x.bucket").alias("tie"), F.col("x.words").alias("words"), F.col("x.n").alias("n")))
        state = state if last else state.select("s", "budget", "prefix")
    # All rows at the edge are alike, so each has words / n words.
    nearest = F.floor(F.col("budget") * F.col("n") / F.col("words") + 0.5).cast("long")
    edges = state.select("s", F.col("prefix").alias("edge"), F.col("tie").alias("edge_tie"), F.col("n").alias("edge_rows"), nearest.alias("edge_taken"))
    return cut(
        budgets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").select(
            F.col("source").alias("mix_source"),
            "source_size",
            "target",
            "repeats",
            F.coalesce("edge", F.lit(1 << (LEVELS * LEVEL_BITS))).alias("edge"),
            F.coalesce("edge_tie", F.lit(0)).cast("long").alias("edge_tie"),
            F.coalesce("edge_rows", F.lit(0)).cast("long").alias("edge_rows"),
            F.coalesce("edge_taken", F.lit(0)).cast("long").alias("edge_taken"),
        )
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``docs`` with ``copies`` (0 to ``max_repeats``), ``size``, ``source_size`` and ``target`` added.

    Sizes are words; a null text, however long a text is, counts whole or 0, and a null source is a source of its own, last in order. Rows that
    repeat an id, text and source are alike: of those at which a budget ends as many are taken once more as fit, one by one. Rows that tie in one hash are
    told apart by the other. An empty table gives no rows. Existing columns with the added names are replaced, all others come back as they
    were, whatever their names. The per-source plan is joined without a hint: Spark broadcasts it only below its size threshold.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copies", "size", "source_size", "target")]
    h, tie = row_hashes(id_col, text_col, source_col)
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"), tie.alias("tie")
    )
    slim = cut(rows.select("source", "size", "h", "tie"))
    mixed = _apply(rows, plan(slim, weights, max_repeats), max_repeats)
    return mixed.select("row.*", "copies", "size", "source_size", "target")


def _apply(rows: DataFrame, by_source: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``rows`` (source, size, h, tie, ...) with the plan of their source and ``copies``."""
    named = rows.join(by_source, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    before = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & (F.col("tie") < F.col("edge_tie")))
    at_edge = (F.col("h") == F.col("edge")) & (F.col("tie") == F.col("edge_tie")) & (F.col("edge_rows") > 0)
    parted = (F.col("edge_taken") > 0) & (F.col("edge_taken") < F.col("edge_rows"))
    whole = named.withColumn("more", before | (at_edge & (F.col("edge_taken") >= F.col("edge_rows"))))
    if not by_source.where(parted).isEmpty():
        split = named.where(at_edge & parted)
        whole = whole.where(~(at_edge & parted)).unionByName(_numbered(split).withColumn("more", F.col("number") <= F.col("edge_taken")).drop("number"))
    copies = F.least(F.col("repeats") + F.col("more").cast("long"), F.lit(max_repeats).cast("long"))
    return whole.withColumn("copies", copies)


def _numbered(alike: DataFrame) -> DataFrame:
    """``alike`` with ``number``, from 1 within each source, in any order, since the rows of a source are alike.

    Counts for each part of the input give each part its first number, so rows that are a third of the table are
    numbered in many tasks.
    """
    placed = cut(alike.withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("source", "part").count()
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.lit(0)))
    found = placed.withColumn("own", own).join(firsts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return found.withColumn("number", F.col("first") + F.col("own")).drop("of", "in", "first", "own", "part")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h, tie = row_hashes("doc_id", "text", "source")
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"), tie.alias("tie")))
    mixed = _apply(slim, plan(slim.select("source", "size", "h", "tie")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
