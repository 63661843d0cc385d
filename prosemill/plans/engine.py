"""The analysis of a corpus as a set of related DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.arrays import each
from prosemill.operators import measures, resolve, rules
from prosemill.operators.mask import masked
from prosemill.operators.scan import FIELDS, Phrase, Scanner, scan
from prosemill.plans.options import RULES, RuleOptions
from prosemill.sources.documents import spread, write_sections


@dataclass(frozen=True)
class ProseEngine:
    """Plans over ``docs`` (doc_id, text). Nothing runs until a result is written or collected.

    ``markdown`` masks what is not prose; ``segmenter`` is ``unicode`` or ``regex``. doc_id must identify a document and may be
    of any type, a struct too. Only enabled rules are planned. Each result is one scan of the texts that gives what
    this result reads, and expressions over a document's row: nothing is shuffled or persisted, so the same plans run on
    streams.
    """

    docs: DataFrame
    options: RuleOptions = field(default_factory=RuleOptions)
    markdown: bool = True
    segmenter: str = "unicode"
    store: DataFrame | None = None

    def scanned(self, *fields: str, phrases: tuple[Phrase, ...] | None = None, echo: measures.EchoOptions = measures.EchoOptions()) -> DataFrame:
        """One row for each document with these fields of ``scan.FIELDS``; from the store if there is one."""
        if self.store is not None and phrases is None and echo == measures.EchoOptions():
            return self.store.select("doc_id", *dict.fromkeys(fields))
        table = rules.phrase_table(self.options) if phrases is None else phrases
        scanner = Scanner(
            tuple(dict.fromkeys(fields)), self.markdown, self.segmenter == "unicode", table if "phrases" in fields else (), (echo.window, echo.min_count, echo.min_length)
        )
        return scan(spread(self.docs.select("doc_id", "text")), scanner)

    def kept(self, path: str, mode: str = "errorifexists") -> ProseEngine:
        """This engine over a table at ``path`` of all that a scan gives: texts are scanned once, and each result reads its own columns.

        Results under other phrases or echo options than the usual ones are scanned anew.
        """
        whole = self.scanned(*FIELDS)
        whole.write.mode(mode).parquet(path)
        return replace(self, store=self.docs.sparkSession.read.schema(whole.schema).parquet(path))

    @cached_property
    def masked(self) -> DataFrame:
        return self.scanned("solid").select("doc_id", masked(F.col("solid")).alias("masked"))

    @cached_property
    def sentences(self) -> DataFrame:
        """``doc_id, sent_idx, from, to, text, words, syllables`` of every sentence that is not blank.

        Offsets are code points in the original text; ``text`` is the masked slice without white space at its ends.
        """
        rows = self.scanned("sent_from", "sent_to", "sent_text", "words", "syllables")
        items = F.arrays_zip(F.col("sent_from").alias("from"), F.col("sent_to").alias("to"), F.col("sent_text").alias("text"), "words", "syllables")
        return each(rows.select("doc_id", items.alias("items")), ["doc_id"], "items", "sent_idx")

    @cached_property
    def spans(self) -> DataFrame:
        """``doc_id, sent_idx, from, to`` of every sentence."""
        items = F.arrays_zip(F.col("sent_from").alias("from"), F.col("sent_to").alias("to"))
        return each(self.scanned("sent_from", "sent_to").select("doc_id", items.alias("items")), ["doc_id"], "items", "sent_idx")

    @cached_property
    def tokens(self) -> DataFrame:
        """``doc_id, tok, from, to, token, lower, spoken`` of every word; ``spoken`` are its syllables."""
        items = F.arrays_zip(F.col("tok_from").alias("from"), F.col("tok_to").alias("to"), "token", "lower", "spoken")
        return each(self.scanned("tok_from", "tok_to", "token", "lower", "spoken").select("doc_id", items.alias("items")), ["doc_id"], "items", "tok")

    @cached_property
    def candidates(self) -> DataFrame:
        return rules.rows(rules.with_marks(self.scanned(*rules.fields(self.options)), self.options))

    def marked(self, *fields: str) -> DataFrame:
        """One row for each document with ``marks``, an array of its marks, besides these fields."""
        found = rules.with_marks(self.scanned(*rules.fields(self.options), *fields), self.options)
        kept = found.select("doc_id", *fields, resolve.without_ignored(F.col("marks"), self.options.ignored()).alias("marks"))
        return resolve.with_resolved(kept)

    @cached_property
    def marks(self) -> DataFrame:
        return rules.rows(self.marked()).drop("seq")

    @cached_property
    def counts(self) -> DataFrame:
        """``doc_id, rule, n`` of the rules that a document has marks of."""
        pairs = F.array(*[F.struct(F.lit(r).alias("rule"), n.alias("n")) for r, n in self._numbers().items()])
        return each(self.marked().select("doc_id", F.filter(pairs, lambda x: x["n"] > 0).alias("pairs")), ["doc_id"], "pairs")

    @staticmethod
    def _numbers() -> dict[str, Column]:
        def number(rule: str) -> Column:
            return F.size(F.filter("marks", lambda m: m["rule"] == rule)).cast("long")

        return {rule: number(rule) for rule in RULES}

    @cached_property
    def readability(self) -> DataFrame:
        return measures.readability(self.scanned(*measures.READABILITY_FIELDS))

    @cached_property
    def summary(self) -> DataFrame:
        """Scores of each document and a column with the count of each rule."""
        scored = measures.readability(self.marked(*measures.READABILITY_FIELDS))
        return scored.select("doc_id", *measures.SCORES, *[n.alias(r) for r, n in self._numbers().items()])

    @cached_property
    def stats(self) -> DataFrame:
        """Readability with the counts of the rules that have any as a map."""
        pairs = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in RULES]), lambda x: x["n"] > 0)
        return self.summary.select("doc_id", *measures.SCORES, F.map_from_entries(pairs).alias("counts"))

    @cached_property
    def snapshot(self) -> DataFrame:
        return measures.snapshot_of(self.summary)

    def rhythm(self, options: measures.RhythmOptions = measures.RhythmOptions()) -> DataFrame:
        return measures.rhythm_of(self.scanned("words"), options)

    def bands(self, options: measures.RhythmOptions = measures.RhythmOptions()) -> DataFrame:
        return measures.bands(self.scanned(*measures.BAND_FIELDS), options)

    def echoes(self, options: measures.EchoOptions = measures.EchoOptions()) -> DataFrame:
        return measures.echoes(self.scanned("terms", echo=options), options)

    def legend(self) -> DataFrame:
        return measures.legend(self.summary, [(r, name) for r, (name, _) in RULES.items() if self.options.enabled(r)])

    def machine_prose_count(self) -> DataFrame:
        """Candidates of machine prose before the ignore list and containment, for every document."""
        found = self.scanned(*rules.MACHINE_FIELDS, phrases=rules.machine_table())
        return found.select("doc_id", rules.machine_count().cast("long").alias("n"))

    def painted(self) -> DataFrame:
        """Marks with their class, empty ones left out."""
        return self.marks.where("`to` > `from`").withColumn("css_class", resolve.css_class(F.col("rule"), F.col("severity")))

    def sections(self) -> dict[str, DataFrame]:
        return {
            "masked": self.masked, "sentences": self.sentences, "marks": self.painted(), "stats": self.stats,
            "rhythm": self.rhythm(), "echoes": self.echoes(), "legend": self.legend(),
        }

    def write_sections(self, path: str, mode: str = "errorifexists") -> None:
        """Each section as a Parquet table below ``path``, from one scan, which is kept there as ``scan``."""
        path = path.rstrip("/")
        write_sections(self.kept(f"{path}/scan", mode).sections(), path, mode)
