"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their ids meet in the whole corpus.

The texts of an Arrow batch are laid end to end as bytes. The ends of all tokens of either tokenizer are counted at their byte
once; where both have one the batch is cut into groups, and running sums read at the documents' ends give each document's
own numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, slices, table
from prosemill.llm.bpe import ByteBpe, default_vocabulary

#: Bytes of text that are aligned at once. Pairs of ids are counted by slice before anything is shuffled.
SLICE_BYTES = 1 << 21
SLICES = (
    "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs array<long>, times array<long>, met array<long>, links binary"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Aligned:
    """Tokens of the texts of a batch that have any: per-text counts, and one entry for each link in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
    """Groups and links of tokens given by their sizes in bytes, of which each text has ``n_a`` and ``n_b``.

    Both sides of a text cover the same bytes and no token is empty, so every byte at which a token of either side ends
    closes exactly one overlap of two tokens: the links. Every byte at which both end closes a group.
    """
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total = int(end_a[-1]) if len(end_a) else 0
    ends_a, ends_b = (np.bincount(e, minlength=total + 1).astype(bool) for e in (end_a, end_b))
    upto_a, upto_b, cuts = (np.cumsum(x, dtype=np.int32) for x in (ends_a, ends_b, ends_a & ends_b))
    links = np.flatnonzero(ends_a | ends_b)
    text_ends = end_a[np.cumsum(n_a) - 1] if len(n_a) else np.empty(0, np.int64)

    def each(upto: np.ndarray) -> np.ndarray:
        return np.diff(upto[text_ends], prepend=0).astype(np.int64)

    n_groups = each(cuts)
    return Aligned(
        n_a, n_b, n_groups, n_a + n_b - n_groups, cuts[end_a - 1], cuts[end_b - 1], upto_a[links - 1], upto_b[links - 1]
    )


class Decimals:
    """Groups written as ``a1,a2|b1;a3|b2,b3``, for a whole batch at once."""

    def __init__(self, most: int):
        ids = np.arange(most)
        self.width = np.char.str_len(ids.astype(str)).astype(np.int32)
        places = np.char.ljust(ids.astype(str), int(self.width.max()))
        self.digits = np.frombuffer(places.astype("S").tobytes(), np.uint8).reshape(most, -1)

    def write(self, a: np.ndarray, b: np.ndarray, x: Aligned) -> list[bytes]:
        """One string for each text. A group's tokens of the first side stand before those of the second."""
        counts_a, counts_b = (np.bincount(g, minlength=int(x.n_groups.sum()) + 1) for g in (x.group_a, x.group_b))
        before_a, before_b = np.cumsum(counts_a), np.cumsum(counts_b) - counts_b
        at_a, at_b = np.arange(len(a)) + before_b[x.group_a], np.arange(len(b)) + before_a[x.group_b]
        n = len(a) + len(b)
        ids, marks = np.empty(n, np.int64), np.empty(n, np.uint8)
        for at, own, group, last in ((at_a, a, x.group_a, b"|"), (at_b, b, x.group_b, b";")):
            ids[at] = own
            marks[at] = np.where(np.diff(group, append=-1) == 0, ord(","), last[0])
        width = self.width[ids]
        ends = np.cumsum(width + 1, dtype=np.int64)
        out = np.empty(int(ends[-1]) if n else 0, np.uint8)
        out[ends - 1] = marks
        starts = ends - width - 1
        for place in range(self.digits.shape[1]):
            shown = width > place
            out[starts[shown] + place] = self.digits[ids[shown], place]
        text_ends = ends[np.cumsum(x.n_a + x.n_b) - 1].tolist()
        whole = out.tobytes()
        return [whole[low : high - 1] for low, high in zip([0, *text_ends], text_ends)]


class Tokenizers:
    """Both tokenizers without special tokens, and the bytes that each id stands for."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        self.a = ByteBpe(vocabulary)
        self.a.special, self.a.specials = {}, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = self.a.bytes_of
        self.bytes_a = [of.get(i, b"") for i in range(max(of) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.decimals = Decimals(max(len(self.bytes_a), len(self.bytes_b)))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text from both; empty for an empty text and where either side's bytes are not a space and the text."""
        given = [" " + t for t in texts]
        a = [np.frombuffer(x, "<u4") for x in self.a.encode_batch(given)]
        b = [np.array(x, np.uint32) for x in self.b.encode(texts, num_threads=1)]
        none = np.empty(0, np.uint32)
        for i, t in enumerate(given):
            raw = t.encode()
            if len(raw) == 1 or any(b"".join(map(of.__getitem__, x[i].tolist())) != raw for of, x in ((self.bytes_a, a), (self.bytes_b, b))):
                a[i] = b[i] = none
        return a, b

    def slice(self, texts: list[str], doc_ids: list[int | None]) -> dict:
        """Everything about one slice of documents: per-document arrays, its distinct pairs of ids, and its packed links."""
        ids_a, ids_b = self.encode(texts)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
        some = n_a > 0
        a, b = (np.concatenate([np.empty(0, np.uint32), *x]).astype(np.int64) for x in (ids_a, ids_b))
        x = align(self.sizes_a[a], self.sizes_b[b], n_a[some], n_b[some])
        shown = iter(self.decimals.write(a, b, x))
        sha = [hashlib.sha256(next(shown)).hexdigest() if k else "" for k in some.tolist()]
        n_groups, n_links = np.zeros_like(n_a), np.zeros_like(n_a)
        n_groups[some], n_links[some] = x.n_groups, x.n_links
        coded = pc.dictionary_encode(pa.array(a[x.link_a] << 32 | b[x.link_b]))
        place = coded.indices.to_numpy().astype(np.int64)
        # Links of a document between the same two ids are one entry with its number.
        keys = np.sort(np.repeat(np.arange(len(texts)), n_links) << 32 | place)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(first, append=len(keys))
        own = keys[first]
        return {
            "doc_id": doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha,
            "pairs": coded.dictionary.to_numpy(), "times": np.bincount(place, minlength=len(coded.dictionary)),
            "met": np.bincount(own >> 32, minlength=len(texts)), "links": _pack(own & 0xFFFFFFFF, times),
        }


def _pack(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places and numbers as bytes, the lowest byte of all before the next of all, which packs well."""
    planes = np.stack((places, times)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(planes).to_bytes(8, "little") + pa.compress(planes.T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1).astype(np.int64)
    return both[0], both[1]


@lru_cache(maxsize=1)
def load(vocabulary: str, pieces: str) -> Tokenizers:
    return Tokenizers(vocabulary, pieces)


def sliced(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, pieces: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row for each slice of documents; see ``SLICES``. Paths are those of the vocabulary files on every executor."""
    paths = vocabulary or default_vocabulary(), pieces or default_pieces()
    schema = pa.schema(
        [("slice", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())),
         *((c, pa.list_(pa.int64())) for c in ("pairs", "times", "met")), ("links", pa.binary())]
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(it, 1, slice_bytes)):
            row = both.slice([t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pylist([row | {"slice": first + number}], schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, SLICES)


def pair_counts(slices: DataFrame) -> DataFrame:
    """``pair`` (A id, then B id in the low 32 bits), ``n`` (its links in the corpus) and ``best`` (no A id has more links with its B id)."""
    found = slices.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    # Rows of one B id are at most the ids of the other vocabulary.
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return found.withColumn("best", F.col("n") == most)


def aligned(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, pieces: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, and one that a tokenizer changes so that its tokens' bytes are not a space and the text, has no tokens: zeros and
    an empty ``groups_sha256``. Repeated rows give a row each and count each time; a null doc_id stays null; an empty table gives no rows;
    other columns are not read, whatever their names. Pairs that tie for a B id's highest count are all best. A text longer than a
    slice is a slice of its own, held whole by its task.

    Texts are encoded once. What is written is the slices' arrays; shuffled are their distinct pairs, to be counted and to bring the counts
    back, and the packed links, which meet the counts of their own slice.
    """
    parts = cut(sliced(docs, text_col, id_col, vocabulary, pieces, slice_bytes))
    counts = cut(pair_counts(parts))
    places = parts.select(F.col("slice").alias("of_slice"), F.posexplode("pairs").alias("place", "pair"))
    heard = places.join(counts, "pair").select("of_slice", "place", "n", "best")
    rows = parts.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "met", "links")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        order = np.argsort(right["place"].to_numpy())
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order]
        place, times = _unpack(row["links"])
        ends = np.cumsum(row["met"])

        def each(x: np.ndarray) -> np.ndarray:
            upto = np.concatenate(([0], np.cumsum(x)))
            return np.diff(upto[ends], prepend=0)

        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
        columns = {c: pa.array(row[c], pa.int64()) for c in names}
        columns |= {"n_best": pa.array(each(times * best[place])), "count_sum": pa.array(each(times * n[place]))}
        return pa.table(columns | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    return rows.groupBy("slice").cogroup(heard.groupBy("of_slice")).applyInArrow(finish, RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
