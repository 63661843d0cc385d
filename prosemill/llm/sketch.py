"""Bottom-k sketches of word-shingle hashes: mergeable document fingerprints."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import slices, table
from prosemill.llm.shingles import chunks, shingle_hashes

SHINGLE_WORDS = 5
SIZE = 128
HASH_BITS = 48
SEED = 42
LOWEST = -(1 << 63)


def text_sketches(texts: list[str | None], k: int = SIZE, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The bottom-k sketch of each text's word shingles: the k smallest distinct 48-bit hashes, ascending.

    Words are runs of bytes other than ASCII white space, lower-cased for A-Z. A text with fewer words than
    ``width`` is one shingle; one without words, or null, has an empty sketch.
    """
    out = []
    for group in chunks(texts):
        hashes, counts = shingle_hashes(group, width, SEED)
        ends = np.cumsum(counts)
        out += [bottom_k(hashes[e - n : e] >> np.uint64(64 - HASH_BITS), k) for e, n in zip(ends, counts)]
    return out


def bottom_k(hashes: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    ordered = np.sort(hashes)
    return ordered[np.concatenate((ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]))][:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The sketch of the union of two parts, equal to the sketch of the whole."""
    return bottom_k(np.concatenate((a, b)), k)


def distinct_count(a: np.ndarray, k: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << HASH_BITS) / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated Jaccard similarity of the shingle sets; exact if their union has at most k shingles.

    Two empty sets resemble each other fully; an empty and a non-empty set not at all.
    """
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    shared = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(shared, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def to_text(sketch: np.ndarray) -> str:
    """URL-safe base64 of the hashes, six big-endian bytes each, ascending."""
    return base64.urlsafe_b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.urlsafe_b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIZE) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (a text form of the sketch) of every row; null texts count as empty."""

    def batches(it):
        for batch in slices(it, 1):
            prints = [to_text(s) for s in text_sketches(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        batches, "doc_id long, fingerprint string"
    )


def merged(sketched: DataFrame, by: str, k: int = SIZE, print_col: str = "fingerprint") -> DataFrame:
    """``by``, the fingerprint of the union of each group's texts, and ``n_distinct``, the estimated number of its shingles.

    ``sketched`` has a fingerprint for each part. Of each task's hashes the k smallest of a group go on, so a group
    of any size is merged from a bounded number of hashes; texts are not read again.
    """

    def hashes(it):
        for batch in it:
            groups, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: dict = {}
            for g, p in zip(groups, prints):
                own = from_text(p or "")
                parts[g] = merge(parts[g], own, k) if g in parts else own
            names = pa.array([g for g, own in parts.items() for _ in range(max(1, len(own)))], batch.schema.field(0).type)
            flat = [x for own in parts.values() for x in (own.astype(np.int64).tolist() or [None])]
            yield pa.RecordBatch.from_arrays([names, pa.array(flat, pa.int64())], ["by", "hash"])

    rows = sketched.select(F.col(by).alias("by"), F.col(print_col).alias("print"))
    smallest = rows.mapInArrow(hashes, rows.select("by").schema.add("hash", "long")).distinct()
    place = F.row_number().over(Window.partitionBy("by").orderBy(F.col("hash").asc_nulls_last()))
    kept = smallest.withColumn("place", place).where(F.col("place") <= k).groupBy("by").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))

    def shown(it):
        for batch in it:
            own = [np.array(h, np.uint64) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(to_text, own), pa.string()), pa.array([distinct_count(o, k) for o in own], pa.float64())],
                ["by", "fingerprint", "n_distinct"],
            )

    schema = kept.select("by").schema.add("fingerprint", "string").add("n_distinct", "double")
    return kept.mapInArrow(shown, schema).withColumnRenamed("by", by)


def with_successors(docs: DataFrame, pieces: int) -> DataFrame:
    """Rows dealt into ``pieces`` ranges of descending doc_id, each followed by the first row of the next range.

    Columns: piece, extra (true for the added row), ord, doc_id, text; sorted within each partition, so one
    ordered pass sees every row together with its successor and only one shuffle moves the texts. Ranges come
    from quantiles of doc_id; what reaches the driver is a few numbers for each range.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("ord"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = rows.select("ord")
    cuts = keys.agg(F.percentile_approx("ord", [i / pieces for i in range(1, pieces)] or [0.5], 10 * pieces).alias("q")).first()["q"]
    inner = sorted({float(c) for c in cuts or []} - {float(LOWEST)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    piece_of = Bucketizer(splits=splits, inputCol="key", outputCol="bucket")

    def placed(df):
        return (
            piece_of.transform(df.withColumn("key", F.col("ord").cast("double")))
            .withColumn("piece", (F.lit(len(splits)) - F.col("bucket")).cast("int"))
            .drop("key", "bucket")
        )

    heads = [tuple(r) for r in placed(keys).groupBy("piece").agg(F.max("ord")).orderBy("piece").collect()]
    follows = [(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)]
    spark = docs.sparkSession
    extra = rows.join(F.broadcast(spark.createDataFrame(follows, "piece int, ord long")), "ord").select(
        "piece", F.lit(True).alias("extra"), "ord", "doc_id", "text"
    )
    own = placed(rows).select("piece", F.lit(False).alias("extra"), "ord", "doc_id", "text")
    return (
        own.unionAll(extra)
        .repartition(pieces, "piece")
        .sortWithinPartitions("piece", "extra", F.desc("ord"), "text")
    )


def edited_pairs(docs: DataFrame, pieces: int | None = None, k: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document.

    Next means descending doc_id, null ids last, equal ids by text; the last is followed by the first. The last
    floor(n_chars / 2) code points are replaced by the first as many of the next text, or all of it if shorter.
    Null texts count as empty; a single row is followed by itself; an empty table gives no rows. ``n_distinct`` estimates
    the text's distinct shingles and ``kept_by_edited`` the share of them that the edited text contains. Other columns are not read; texts of any
    length are hashed whole. Rows of one id are one range: an id that a third of all rows share is one task's.
    """
    spark = docs.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next n_distinct kept_by_edited".split()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def batches(it):
        last = None
        for batch in slices(it, 3):
            piece, extra, doc_id, text = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
            rows, edited = [], []
            for p, e, d, t, own in zip(piece, extra, doc_id, text, text_sketches(text, k)):
                if last is not None and last[0] == p:
                    _, before, whole, sketch = last
                    half = len(whole) // 2
                    edited.append(whole[: len(whole) - half] + t[:half])
                    rows.append((before, len(whole), sketch, resemblance(sketch, own, k)))
                last = None if e else (p, d, t, own)
            if not rows:
                continue
            ids, sizes, own, near_next = zip(*rows)
            changed = text_sketches(edited, k)
            columns = [
                ids, sizes, [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], map(to_text, own),
                map(to_text, changed), [resemblance(a, b, k) for a, b in zip(own, changed)], near_next,
                [distinct_count(a, k) for a in own], [containment(a, b, k) for a, b in zip(own, changed)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names)

    return with_successors(docs, pieces).select("piece", "extra", "doc_id", "text").mapInArrow(
        batches,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "n_distinct double, kept_by_edited double",
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
