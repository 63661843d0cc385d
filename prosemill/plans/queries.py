"""Registered queries over the benchmark tables. Every one covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions.sql import register_functions, register_views
from prosemill.functions.text import skip_text, status_text, word_at
from prosemill.operators import measures, navigate, resolve, rules
from prosemill.plans import planted, reports
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions
from prosemill.sources.documents import changed, guard
from prosemill.streaming.revisions import baselines, debounce

#: Rules that SQL expresses in full. Hedges, cliches and machine prose do not run under these, so their counts are
#: zero by definition; the ``full_`` queries run every rule.
RELATIONAL = RuleOptions(rules={"hedge": False, "cliche": False})
GUARD_CHARS = 5000
BURST = "10 minutes"

Query = Callable[[SparkSession, str], DataFrame]
Engine = Callable[[SparkSession, str], ProseEngine]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(spark: SparkSession, sf_dir: str, options: RuleOptions = RELATIONAL) -> ProseEngine:
    """Documents as plain prose, regex sentences: the form whose results SQL can state."""
    return ProseEngine(_documents(spark, sf_dir), options, markdown=False, segmenter="regex")


def full(spark: SparkSession, sf_dir: str) -> ProseEngine:
    """Documents as Markdown, Unicode sentences, every rule."""
    return ProseEngine(_documents(spark, sf_dir), RuleOptions(is_pro=True))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir).scanned("lower").where(F.size("lower") > 0)
    return rows.select("doc_id", F.size("lower").cast("long").alias("words"), F.size(F.array_distinct("lower")).cast("long").alias("distinct_words"))


def syllable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = plain(spark, sf_dir).scanned("spoken").where(F.size("spoken") > 0)
    return tokens.select("doc_id", F.aggregate("spoken", F.lit(0).cast("long"), lambda a, x: a + x).alias("syllables"))


def sentences(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    rows = engine(spark, sf_dir).sentences
    return rows.select("doc_id", "sent_idx", F.col("from").alias("start"), F.col("to").alias("stop"), "words", "syllables")


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).readability


def _with_facts(engine: ProseEngine, *facts: str) -> ProseEngine:
    """The engine over documents whose id carries these columns, so that results can be grouped by them without a join."""
    docs = engine.docs.select(F.struct("doc_id", *facts).alias("doc_id"), "text")
    return replace(engine, docs=docs)


def ease_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _with_facts(plain(spark, sf_dir), "lang").readability
    return scored.groupBy(F.col("doc_id.lang").alias("lang"), "ease").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = status_text(F.col("grade"), F.col("flesch"), F.col("words"))
    return plain(spark, sf_dir).readability.select("doc_id", shown.alias("status"))


def _spans(marks: DataFrame) -> DataFrame:
    return marks.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"), "rule", "severity", "word")


def _lexical(engine: ProseEngine, options: RuleOptions = RuleOptions()) -> DataFrame:
    return rules.rows(engine.scanned(*rules.WORD_FIELDS), rules.lexical_marks(options))


def lexical_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_lexical(plain(spark, sf_dir)))


def adverb_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = RuleOptions(rules={"weasel": False, "hedge": False})
    return _spans(_lexical(plain(spark, sf_dir), only))


def doubled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(rules.rows(plain(spark, sf_dir).scanned(*rules.WORD_FIELDS, *rules.SENTENCE_FIELDS), rules.doubled_marks()))


def passive_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = plain(spark, sf_dir).scanned(*rules.WORD_FIELDS, *rules.SENTENCE_FIELDS)
    return _spans(rules.rows(rules.with_passive(scanned), rules.passive_marks()))


def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.rows(plain(spark, sf_dir).scanned(*rules.SENTENCE_FIELDS), rules.long_marks(RuleOptions()))
    return rows.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"), "rule", "severity", "message")


def relational_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(plain(spark, sf_dir).marks)


def ignored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lexical(plain(spark, sf_dir))
    return _spans(resolve.drop_ignored(found, RuleOptions(ignored_words=(" Erly", "thly", "inly")).ignored()))


def rule_counts(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    return engine(spark, sf_dir).counts


def legend_counts(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    return engine(spark, sf_dir).legend().select("doc_id", "rule", "n", "total")


def corpus_rollup(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    found = _with_facts(engine(spark, sf_dir), "lang", "source").counts
    named = found.select(F.col("doc_id.lang").alias("lang"), F.col("doc_id.source").alias("source"), "rule", "n", F.col("doc_id.doc_id").alias("doc_id"))
    return named.rollup("lang", "source", "rule").agg(F.sum("n").alias("marks"), F.countDistinct("doc_id").alias("docs"))


def sentence_bands(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    return engine(spark, sf_dir).bands().select("doc_id", "sent_idx", "words", "band", "bar_width")


def variety(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    return engine(spark, sf_dir).rhythm().select("doc_id", "variety")


def monotone_runs(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    return measures.flat_sentences(engine(spark, sf_dir).rhythm())


def echoes(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    rows = engine(spark, sf_dir).echoes()
    return rows.select("doc_id", "term", "kind", "count", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), "text")


def revision_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last turn of each conversation as two versions of one document; see RELATIONAL for what runs."""
    return _delta(spark, sf_dir, lambda docs: ProseEngine(docs, RELATIONAL, markdown=False, segmenter="regex"))


def full_revision_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every rule."""
    return _delta(spark, sf_dir, lambda docs: ProseEngine(docs, RuleOptions(is_pro=True)))


def _delta(spark: SparkSession, sf_dir: str, engine: Callable[[DataFrame], ProseEngine]) -> DataFrame:
    ends = baselines(_turns(spark, sf_dir))
    sides = F.array(*[F.struct(F.struct("doc_id", F.lit(side).alias("side")).alias("doc_id"), F.col(side)["text"].alias("text")) for side in ("before", "after")])
    snapshots = engine(ends.select(F.explode(sides).alias("x")).select("x.*")).snapshot
    own = snapshots.select(F.col("doc_id.side").alias("side"), F.col("doc_id.doc_id").alias("doc_id"), *[c for c in snapshots.columns if c != "doc_id"])
    return measures.side_delta(own).select("doc_id", "key", "before", "after", "delta", "better")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any metric of a conversation moved between its first and last turn."""
    return measures.has_moved(revision_delta(spark, sf_dir))


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are new or not as they were, against a store of two thirds of them, half of those in another form."""
    docs = _documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    known = docs.where("doc_id % 3 < 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.concat(text, F.lit("x"))), 256).alias("text_hash"))
    return changed(docs, known).select("doc_id", "text_hash")


def fifth_adverbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark that five steps along the adverbs of each document lead to, counted round."""
    walks = _documents(spark, sf_dir).select("doc_id", F.lit("adverb").alias("rule"), F.lit(5).alias("step"))
    found = navigate.nth_of_rule(_lexical(plain(spark, sf_dir)), walks)
    return found.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"))


def _middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.floor(F.length("text") / 2).cast("int")
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", middle.alias("cursor"), word_at(F.col("text"), middle).alias("word"))


def words_at_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _middles(spark, sf_dir)


def marks_at_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical mark of the word in the middle of each document."""
    lookups = _middles(spark, sf_dir).withColumn("word", F.lower("word"))
    found = navigate.mark_of_word(_lexical(plain(spark, sf_dir)), lookups)
    return found.select("doc_id", "cursor", F.col("from").alias("start"), F.col("to").alias("stop"), "rule")


def dimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is dimmed around the sentence in the middle of each document."""
    lengths = _documents(spark, sf_dir).select("doc_id", F.length("text").alias("length"))
    found = navigate.focus_ranges(plain(spark, sf_dir).spans, _middles(spark, sf_dir).drop("word"), lengths)
    shown = F.transform("ranges", lambda r: F.concat_ws("-", r["from"], r["to"]))
    return found.select("doc_id", "cursor", F.array_join(shown, ",").alias("ranges"))


def next_mark(spark: SparkSession, sf_dir: str, forward: bool = True) -> DataFrame:
    """The lexical mark after, or before, the middle of each document, going round at the ends."""
    engine = plain(spark, sf_dir)
    cursors = _documents(spark, sf_dir).select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("cursor"))
    found = navigate.step_mark(_lexical(engine), cursors, forward)
    return found.select("doc_id", "cursor", F.col("from").alias("start"), F.col("to").alias("stop"), "rule")


def cursor_sentence(spark: SparkSession, sf_dir: str, engine: Engine = plain) -> DataFrame:
    cursors = _documents(spark, sf_dir).select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("cursor"))
    found = navigate.sentence_at(engine(spark, sf_dir).spans, cursors)
    return found.select("doc_id", "cursor", F.col("from").alias("start"), F.col("to").alias("stop"), "sent_idx")


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rows = guard(docs, GUARD_CHARS, docs.where("doc_id % 10 = 0"))
    text = skip_text(F.col("skip.reason"), F.col("skip.chars"), F.col("skip.limit"))
    return rows.select("doc_id", F.col("skip.reason").alias("reason"), F.col("skip.chars").cast("long").alias("chars"), text.alias("said"))


def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), "ts", F.col("event_type").alias("text"))
    return debounce(rows, BURST).select("doc_id", "version", "text", "revisions")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(full(spark, sf_dir).marks)


def markdown_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).readability


def machine_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).machine_prose_count()


def sql_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, syllables and the longest word of every document by language, in SQL with the functions of this package."""
    register_functions(spark)
    _documents(spark, sf_dir).createOrReplaceTempView("sql_documents")
    return spark.sql("""
        SELECT lang, source, sum(n) AS words, CAST(sum(n * spoken) AS BIGINT) AS syllables, max(spoken) AS most,
          ease_label(round1(100 - 10 * CAST(sum(n * spoken) AS DOUBLE) / sum(n))) AS ease
        FROM (SELECT lang, source, n, syllables(word) AS spoken FROM (SELECT lang, source, word, count(*) AS n
          FROM (SELECT lang, source, explode(own) AS word FROM (SELECT lang, source, prose_words(text) AS own FROM sql_documents)) GROUP BY lang, source, word))
        GROUP BY lang, source""")


def sql_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adverbs and passives of long documents, by SQL over an engine's views."""
    register_views(plain(spark, sf_dir), "drafts")
    return spark.sql("""
        SELECT m.doc_id, m.rule, count(*) AS n, min(m.`from`) AS first, s.grade FROM drafts_marks m JOIN drafts_scores s ON s.doc_id = m.doc_id
        WHERE m.rule IN ('adverb', 'passive') AND s.words > 100 GROUP BY m.doc_id, m.rule, s.grade""")


def remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of each user's text through that user's events, taken for edits of it in their order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    low = F.col("event_id") % 500
    edits = events.select(F.col("user_id").alias("doc_id"), seq.cast("long").alias("seq"), low.alias("from"), (low + F.col("event_id") % 5).alias("to"), (F.col("event_id") % 4).alias("insert"))
    maps = navigate.composed(edits)
    offsets = events.select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, 600, 60)])).alias("offset"))
    return navigate.remap_sides(maps, offsets)


def length_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of sentence length and numbers of different words by language and source, from sketches that merge.

    Each group has one KLL sketch of its sentences' lengths and one HLL sketch of its words, and the rows of a language and of the whole are
    unions of these: no group is sorted and no word list is shuffled.
    """
    engine = _with_facts(plain(spark, sf_dir), "lang", "source")
    rows = engine.scanned("words", "lower").select(F.col("doc_id.lang").alias("lang"), F.col("doc_id.source").alias("source"), "words", "lower")
    return measures.sketched(rows, ["lang", "source"])


def page_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    masked = ProseEngine(pages).masked
    return masked.select("doc_id", F.length("masked").alias("chars"), F.regexp_count("masked", F.lit("[^\\s]")).alias("prose_chars"))


QUERIES: dict[str, Query] = {
    "word_counts": word_counts,
    "syllable_totals": syllable_totals,
    "sentences": sentences,
    "readability": readability,
    "ease_histogram": ease_histogram,
    "status_lines": status_lines,
    "lexical_marks": lexical_marks,
    "adverb_marks": adverb_marks,
    "doubled_words": doubled_words,
    "passive_marks": passive_marks,
    "long_sentences": long_sentences,
    "relational_marks": relational_marks,
    "ignored_marks": ignored_marks,
    "rule_counts": rule_counts,
    "legend_counts": legend_counts,
    "corpus_rollup": corpus_rollup,
    "sentence_bands": sentence_bands,
    "variety": variety,
    "monotone_runs": monotone_runs,
    "echoes": echoes,
    "revision_delta": revision_delta,
    "next_mark": next_mark,
    "previous_mark": partial(next_mark, forward=False),
    "cursor_sentence": cursor_sentence,
    "guarded": guarded,
    "event_bursts": event_bursts,
    "marks": marks,
    "markdown_readability": markdown_readability,
    "machine_prose": machine_prose,
    "page_masks": page_masks,
    "sql_scores": sql_scores,
    "sql_marks": sql_marks,
    "remapped": remapped,
    "length_sketches": length_sketches,
    "full_rule_counts": partial(rule_counts, engine=full),
    "full_legend_counts": partial(legend_counts, engine=full),
    "full_corpus_rollup": partial(corpus_rollup, engine=full),
    "full_revision_delta": full_revision_delta,
    "full_sentences": partial(sentences, engine=full),
    "full_sentence_bands": partial(sentence_bands, engine=full),
    "full_variety": partial(variety, engine=full),
    "full_monotone_runs": partial(monotone_runs, engine=full),
    "full_echoes": partial(echoes, engine=full),
    "full_cursor_sentence": partial(cursor_sentence, engine=full),
    "moved": moved,
    "changed_documents": changed_documents,
    "fifth_adverbs": fifth_adverbs,
    "words_at_middle": words_at_middle,
    "marks_at_middle": marks_at_middle,
    "dimmed": dimmed,
    **planted.QUERIES,
    **reports.QUERIES,
}
