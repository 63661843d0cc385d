"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm._shared import slices, table

CACHE_ENTRIES = 150_000
GROUP_CHARS = 1_500_000
BULK_BYTES = 32
BULK_ROWS = 1 << 12
NO_RANK = (1 << 31) - 1

# The Unicode white space of the tokenizer's split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankTree:
    """Minimum segment tree over pair ranks: leftmost minimum at the root, logarithmic updates."""

    def __init__(self, ranks: list[int]):
        self.base = 1 << max(0, (len(ranks) - 1).bit_length())
        tree = [NO_RANK] * (2 * self.base)
        tree[self.base : self.base + len(ranks)] = ranks
        for i in range(self.base - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
        self.tree = tree

    def leftmost(self) -> int:
        """Index of the leftmost lowest rank, or -1 if no pair can be merged."""
        tree, i = self.tree, 1
        low = tree[1]
        if low == NO_RANK:
            return -1
        while i < self.base:
            i = 2 * i if tree[2 * i] == low else 2 * i + 1
        return i - self.base

    def put(self, at: int, rank: int) -> None:
        tree, i = self.tree, at + self.base
        tree[i] = rank
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            low = left if left <= right else right
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode("utf-8") for token, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, bytes] = {}
        order = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in self.pairs.items())
        self.keys = np.array([x[0] for x in order] or [-1], np.int64)
        self.key_ranks = np.array([x[1] for x in order] or [NO_RANK], np.int32)
        self.made = np.zeros(len(order) + 1, np.int32)
        self.made[self.key_ranks[: len(order)]] = [x[2] for x in order]
        self.byte_table = np.array(self.byte_ids, np.int32)
        self.byte_ranks = self.ranks(self.byte_table[:, None], self.byte_table[None, :]).astype(np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: merge the leftmost lowest-rank pair until none is left."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        pairs, none = self.pairs, (NO_RANK, -1)
        tree = RankTree([pairs.get(p, none)[0] for p in zip(ids, ids[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.leftmost()) >= 0:
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            k = after[j]
            after[i] = k
            ids[j] = -1
            if j < n - 1:
                tree.put(j, NO_RANK)
            if k < n:
                before[k] = i
                tree.put(i, pairs.get((ids[i], ids[k]), none)[0])
            else:
                tree.put(i, NO_RANK)
            if (h := before[i]) >= 0:
                tree.put(h, pairs.get((ids[h], ids[i]), none)[0])
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: list[bytes], base: int) -> list[bytes]:
        """``merge`` for many pieces of at most ``base`` bytes (a power of two): one tree per row, updated together."""
        m, depth = len(pieces), base.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        inside = np.arange(base + 1) < sizes[:, None]
        ids = np.full((m, base + 1), -1, np.int32)
        raw = np.zeros((m, base + 1), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids[inside] = self.byte_table[raw[inside]]
        after = np.tile(np.arange(1, base + 2, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, base, dtype=np.int32), (m, 1))
        tree = np.full((m, 2 * base), NO_RANK, np.int32)
        tree[:, base:] = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NO_RANK)
        for level in range(depth - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])

        def put(rows, at, rank):
            node = at + base
            tree[rows, node] = rank
            for _ in range(depth):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NO_RANK)
        while len(rows):
            low = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + (tree[rows, 2 * node] != low)
            i = node - base
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            made = self.made[low]
            ids[rows, i] = made
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, np.minimum(k, base)] = i
            put(rows, j, NO_RANK)
            put(rows, i, self.ranks(made, ids[rows, np.minimum(k, base)]))
            has = h >= 0
            put(rows[has], h[has], self.ranks(ids[rows[has], h[has]], made[has]))
            rows = rows[tree[rows, 1] < NO_RANK]
        left = ids >= 0
        flat, ends = ids[left].astype("<u4").tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | (b & 0xFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_ranks[at], NO_RANK)

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of pieces into the cache: short ones together, long ones one by one."""
        raw = list(map(str.encode, pieces))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        low, base = 0, 2
        while base <= BULK_BYTES:
            found = np.flatnonzero((sizes > low) & (sizes <= base)).tolist()
            for at in range(0, len(found), BULK_ROWS):
                part = found[at : at + BULK_ROWS]
                merged = self.merge_all([raw[i] for i in part], base)
                self.cache.update(zip([pieces[i] for i in part], merged))
            low, base = base, 2 * base
        for i in np.flatnonzero(sizes > BULK_BYTES).tolist():
            self.cache[pieces[i]] = pack(self.merge(raw[i]))
        for name, i in self.special.items():
            self.cache[name] = pack([i])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a whole text within which pairs merge; special tokens stand alone."""
        if self.specials is None or not self.specials.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.split.findall(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed token ids of whole texts, in order; strings of special tokens become their ids, null gives none."""
        for group in _groups(texts):
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            split = [self.pieces(text) for text in group]
            self.learn(list(set().union(*split).difference(self.cache)))
            for pieces in split:
                yield b"".join(map(self.cache.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the text decoded from them) added.

    Null texts count as empty and give no ids. Existing columns called ids or decoded are replaced; all others
    are kept. An empty table gives no rows; a text is encoded whole, however long, so its ids are held in one row. ``vocabulary`` is the path of the vocabulary file on every executor.
    """
    path = vocabulary or default_vocabulary()
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    at = kept.index(text_col)

    def batches(it):
        bpe = load(path)
        for batch in slices(it, at):
            ids = list(bpe.encode_batch(batch.column(at).to_pylist()))
            decoded = [bpe.decode(i) for i in ids]
            lists = pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))
            columns = [*batch.columns, lists, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(batches, schema)


def digests(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` for every row, without moving the ids.

    Null texts count as empty, repeated rows give a row each, an empty table gives no rows, other columns are not read. A text is encoded
    whole, however long.
    """
    path = vocabulary or default_vocabulary()

    def batches(it):
        bpe = load(path)
        for batch in slices(it, 1):
            rows = ([], [], [])
            for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
