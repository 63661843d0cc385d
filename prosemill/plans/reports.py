"""Queries of what a reader of the results is shown: status lines, links, changes in words, stored settings, other offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.settings import settings_of
from prosemill.functions.text import signed, singular, skip_status, skip_text, status_explained, status_text, utf16_offset, web_url
from prosemill.operators import measures
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RULES
from prosemill.sources.documents import guard

GUARD_CHARS = 5000


def status_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status line of every document and its explanation; skipped ones say so. Every tenth is muted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = guard(docs, GUARD_CHARS, docs.where("doc_id % 10 = 0"))
    named = rows.select(F.struct("doc_id", "skip").alias("doc_id"), F.when(F.col("skip").isNull(), F.col("text")).alias("text"))
    scored = ProseEngine(named, markdown=False, segmenter="regex").readability.select("doc_id.*", "grade", "flesch", "words")
    reason = F.col("skip.reason")
    return scored.select(
        "doc_id",
        F.coalesce(skip_status(reason), status_text(F.col("grade"), F.col("flesch"), F.col("words"))).alias("status"),
        F.coalesce(skip_text(reason, F.col("skip.chars"), F.col("skip.limit")), status_explained(F.col("grade"), F.col("flesch"), F.col("words"))).alias("explained"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL where it may be opened; every third is given another scheme, every seventh none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?", "javascript")).when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^.*//", "")).otherwise(F.col("url"))
    return pages.select("page_id", web_url(url, "-").alias("link"))


def delta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as they are shown, of sizes against words of every document as two snapshots of one text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, after = (F.coalesce(x, F.lit(0)).cast("double") for x in (F.length("text") / 10, F.col("n_chars") % 100))
    change = F.round(after - before, 1)
    label = F.get(F.array(*[F.lit(name) for name, _ in RULES.values()]), (F.col("doc_id") % len(RULES)).cast("int"))
    return docs.select("doc_id", singular(label).alias("label"), signed(change).alias("shown"))


def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle and the end of every text, counted in UTF-16 units; every word in -e before a space is followed by a character beyond the first plane."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "e ", "e🎯 ")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"))
    middle = F.floor(F.length("text") / 2).cast("int")
    return rows.select("doc_id", utf16_offset(F.col("text"), middle).alias("middle"), utf16_offset(F.col("text"), F.length("text")).alias("end"))


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read from a JSON text that each document's numbers make, with wrong types, bounds and shapes."""
    found = settings_of(F.expr(STORED))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", found.alias("s"))
    return docs.select(
        "doc_id", F.col("s.long_sentence_words").alias("long_words"), F.col("s.very_long_sentence_words").alias("very_long_words"), F.col("s.max_note_chars").alias("most_chars"),
        F.col("s.is_pro").alias("paid"), F.col("s.rules")["hedge"].alias("hedge"), F.array_join("s.ignored_words", "|").alias("ignored"), F.col("s.license_email").alias("email"),
        F.col("s.marks_enabled").alias("marks"),
    )


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band classes over the corpus: how many sentences each class paints, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    rows = ProseEngine(docs, markdown=False, segmenter="regex").bands(measures.RhythmOptions.of(short_max=5, long_min=20, very_long_min=float("nan")))
    return rows.groupBy(F.col("doc_id.lang").alias("lang"), "css_class").agg(F.count("*").alias("n"))


#: A JSON text of each row, in words that Spark and DuckDB share.
STORED = """concat('{"longSentenceWords": ', CASE doc_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"30"' WHEN 2 THEN concat(cast(doc_id % 60 as string), '.5') ELSE cast(doc_id % 60 as string) END,
 ', "veryLongSentenceWords": ', cast((doc_id * 7) % 90 as string), ', "maxNoteChars": ', CASE doc_id % 3 WHEN 0 THEN '[1]' ELSE cast(doc_id * 1000 as string) END,
 ', "isPro": ', CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' ELSE '1' END, ', "rules": ', CASE doc_id % 6 WHEN 0 THEN '{"hedge": false, "gone": true}' WHEN 1 THEN '{"hedge": "no"}' ELSE '[]' END,
 ', "ignoredWords": ', CASE doc_id % 2 WHEN 0 THEN '["a", 3, null, "b c"]' ELSE '"a"' END, ', "licenseEmail": ', CASE doc_id % 3 WHEN 1 THEN '"x@y"' ELSE '5' END,
 ', "marksEnabled": ', CASE doc_id % 7 WHEN 0 THEN 'false' ELSE '0' END, CASE doc_id % 11 WHEN 0 THEN '' ELSE '}' END)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "status_bar": status_bar, "page_links": page_links, "delta_lines": delta_lines, "utf16_lengths": utf16_lengths, "stored_settings": stored_settings, "section_counts": section_counts,
}


def oracle_sql(documents: str) -> dict[str, str]:
    """SQL for these queries; ``documents`` are the common table expressions of all documents' sentences and scores."""
    label = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{name.removesuffix('s')}'" for i, (name, _) in enumerate(RULES.values())) + " END"
    return {
        "status_bar": documents
        + """ SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'Prose muted' WHEN length(coalesce(d.text, '')) > 5000 THEN 'Prose paused'
  WHEN words > 0 THEN printf('Grade %.1f · ', grade) || ease END AS status,
  CASE WHEN d.doc_id % 10 = 0 THEN 'Marks are muted for this note.' WHEN length(coalesce(d.text, '')) > 5000 THEN 'This note is too large for live analysis (' ||
    format('{:,}', length(d.text)) || ' characters, limit 5,000). Raise the limit in settings, under Performance.'
  WHEN words > 0 THEN format('{:,}', words) || ' words · Flesch–Kincaid grade ' || printf('%.1f', grade) || ' — the US school grade needed to read this note; most web writing lands 6–9. Reading ease '
    || floor(flesch + 0.5)::INT || ' (' || ease || ').' END AS explained
FROM labelled JOIN documents d USING (doc_id)""",
        "page_links": """SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 7 = 0 THEN CASE WHEN regexp_matches(url, '^https?') THEN '-' ELSE '-' END
  WHEN regexp_matches(url, '^(?i)https?://') THEN url ELSE '-' END AS link FROM pages""",
        "delta_lines": f"""SELECT doc_id, {label} AS label, CASE WHEN d > 0 THEN '+' || s WHEN d < 0 THEN s END AS shown FROM (
  SELECT doc_id, d, regexp_replace(printf('%.1f', d), '\\.0$', '') AS s FROM (
    SELECT doc_id, round(coalesce(n_chars % 100, 0) - coalesce(length(text) / 10, 0), 1) AS d FROM documents))""",
        "utf16_lengths": """SELECT doc_id, (m + len(regexp_extract_all(substr(t, 1, m), '🎯')))::INT AS middle, (length(t) + len(regexp_extract_all(t, '🎯')))::INT AS "end"
FROM (SELECT doc_id, t, (length(t) // 2)::INT AS m FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), 'e ', 'e🎯 ', 'g') AS t FROM documents))""",
        "stored_settings": f"""WITH j AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '{{}}' ELSE {STORED} END::JSON AS j FROM documents),
n AS (SELECT doc_id, j, CASE WHEN json_type(j, '$.longSentenceWords') IN ('UBIGINT', 'DOUBLE') THEN greatest(15, least(45, floor((j->>'$.longSentenceWords')::DOUBLE + 0.5))) ELSE 25 END AS a,
  CASE WHEN json_type(j, '$.veryLongSentenceWords') = 'UBIGINT' THEN greatest(25, least(70, (j->>'$.veryLongSentenceWords')::INT)) ELSE 40 END AS b FROM j)
SELECT doc_id, a::INT AS long_words, greatest(a + 1, b)::INT AS very_long_words,
  (CASE WHEN json_type(j, '$.maxNoteChars') = 'UBIGINT' THEN greatest(50000, least(400000, (j->>'$.maxNoteChars')::BIGINT)) ELSE 300000 END)::INT AS most_chars,
  coalesce(json_type(j, '$.isPro') = 'BOOLEAN' AND (j->>'$.isPro') = 'true', false) AS paid, NOT coalesce(json_type(j, '$.rules.hedge') = 'BOOLEAN' AND (j->>'$.rules.hedge') = 'false', false) AS hedge,
  CASE WHEN json_type(j, '$.ignoredWords') = 'ARRAY' THEN 'a|b c' ELSE '' END AS ignored, CASE WHEN json_type(j, '$.licenseEmail') = 'VARCHAR' THEN j->>'$.licenseEmail' ELSE '' END AS email,
  NOT coalesce(json_type(j, '$.marksEnabled') = 'BOOLEAN', false) AS marks FROM n""",
        "section_counts": documents
        + """ SELECT lang, CASE WHEN words <= 5 THEN 'pl-heat pl-heat-short' WHEN words >= 40 THEN 'pl-heat pl-heat-verylong' WHEN words >= 20 THEN 'pl-heat pl-heat-long'
  ELSE 'pl-heat pl-heat-medium' END AS css_class, count(*) AS n FROM sentences JOIN documents USING (doc_id) GROUP BY ALL""",
    }
