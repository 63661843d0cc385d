"""Language identification: FTRL-trained sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._shared import slices, table

BINS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 2
CALIBRATION_SHARE = 5
UNDETERMINED = "und"
SLICE = 1 << 20


class _Letters(dict):
    """Each code point of category L as itself, all others as a space; for ``str.translate``."""

    def __missing__(self, point: int) -> int:
        self[point] = value = point if unicodedata.category(chr(point))[0] == "L" else 32
        return value


_LETTERS = _Letters()


@dataclass(frozen=True)
class FtrlSettings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the hashed character n-grams of a whole text.

    Letters (Unicode category L) are lower-cased and every run of other characters becomes one space, also at both
    ends. A text without letters, or null, has none.
    """
    words = (text or "").lower().translate(_LETTERS).split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + max(ORDERS) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(part) - n + 1] * np.uint32(2654435761) + part[n - 1 :]
            if n in ORDERS and len(h):
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519 + 2 * n)
                total += np.bincount((mixed >> np.uint32(17))[:SLICE], minlength=BINS)
    bins = np.flatnonzero(total)
    return bins, total[bins]


def weigh(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency, scaled to length one."""
    x = (1.0 + np.log(counts)) * idf[bins]
    length = float(np.sqrt(x @ x))
    return x / length if length else x


class Ftrl:
    """Follow-the-regularised-leader (proximal) for softmax regression with elastic-net penalties."""

    def __init__(self, classes: int, settings: FtrlSettings = FtrlSettings()):
        self.s = settings
        self.z = np.zeros((BINS, classes))
        self.n = np.zeros((BINS, classes))

    def weights(self, bins: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, s = self.z[bins], self.n[bins], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, bins: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(bins)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[bins]
        self.z[bins] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[bins] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises log loss, by golden-section search on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -1.4, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    table: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` with score 0 without letters or without a model."""
        bins, counts = ngram_counts(text)
        if not len(bins) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(weigh(bins, counts, self.idf) @ self.table[bins] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of documents that is never learned from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bin occurs, and the number of texts with letters.

    Each task sends one row for each bin at most, whatever it has read, and Spark adds them up.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS, np.int64), 0
        for batch in slices(it, 0):
            for text in batch.column(0).to_pylist():
                bins, _ = ngram_counts(text)
                seen[bins] += 1
                n += bool(len(bins))
        bins = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*bins, -1], pa.int64()), pa.array([*seen[bins], n], pa.int64())], ["bin", "n"])

    rows = texts.mapInArrow(batches, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = {r["bin"]: r["n"] for r in rows}
    total = found.pop(-1, 0)
    frequencies = np.zeros(BINS)
    for i, n in found.items():
        frequencies[i] = n
    return frequencies, total


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    settings: FtrlSettings = FtrlSettings(),
) -> LanguageModel:
    """Fit on the rows that are not held out and have a language.

    Document frequencies cover every such text. The classifier itself is fitted on a sample of about
    ``sample_per_language`` whole texts for each language (a documented bound), chosen by a hash of the id, of
    which a fifth is kept for the temperature. Only the n-gram counts of the sample reach the driver. Ids may be of any
    type that casts to string, null or repeated; rows with null text or no letters teach nothing; an empty table gives
    a model without languages.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    frequencies, total = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + total) / (1.0 + frequencies)) + 1.0
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), idf, np.zeros((BINS, 0)), 1.0)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, sample_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 1):
            pairs = [ngram_counts(t) for t in batch.column("text").to_pylist()]
            packed = [[a.astype("<u2").tobytes() for a, _ in pairs], [c.astype("<u4").tobytes() for _, c in pairs]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *(pa.array(p, pa.binary()) for p in packed)],
                ["doc_id", "lang", "bins", "counts"],
            )

    rows = sample.mapInArrow(counted, "doc_id string, lang string, bins binary, counts binary").collect()
    rng = np.random.default_rng(7)
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or "", r["bins"]))
    label = {k: i for i, k in enumerate(languages)}
    examples = []
    for r in rows:
        bins = np.frombuffer(r["bins"], "<u2").astype(np.int64)
        if len(bins):
            examples.append((bins, weigh(bins, np.frombuffer(r["counts"], "<u4"), idf), label[r["lang"]]))
    keep = rng.permutation(len(examples))
    kept, fitted = keep[: len(keep) // CALIBRATION_SHARE], keep[len(keep) // CALIBRATION_SHARE :]
    model = Ftrl(len(languages), settings)
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            model.learn(*examples[i])
    w = model.weights()
    logits = np.array([x @ w[bins] for bins, x, _ in (examples[i] for i in kept)]).reshape(len(kept), len(languages))
    return LanguageModel(languages, idf, w, calibrate(logits, np.array([examples[i][2] for i in kept], np.int64)))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, from the whole text alone; without the text if not ``keep_text``.

    Null texts, and texts without letters, are ``und`` with score 0. Existing columns with the added names are
    replaced and all others kept; an empty table gives no rows; texts of any length are read whole.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)
    sent = [i for i in range(len(kept)) if keep_text or i != at]
    names = [*(kept[i] for i in sent), "lang_pred", "score"]
    schema = docs.select(*(kept[i] for i in sent)).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(it, at):
            found = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in sent), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names,
            )

    return docs.select(*kept).mapInArrow(batches, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model, keep_text=False)
