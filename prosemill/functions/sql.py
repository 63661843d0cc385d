"""The analysis from plain SQL: functions on words and numbers, and views of an engine's results with a function over them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from prosemill.functions.text import LETTERS, SILENT_END
from prosemill.plans.engine import ProseEngine

#: Name, parameters, result and body of each function; all are expressions that Catalyst inlines.
FUNCTIONS = (
    (
        "syllables", "word STRING", "INT",
        "CASE WHEN length(regexp_replace(lower(word), '[^a-z]', '')) <= 3 THEN CAST(length(regexp_replace(lower(word), '[^a-z]', '')) > 0 AS INT) ELSE "
        f"greatest(1, regexp_count(regexp_replace(regexp_replace(regexp_replace(lower(word), '[^a-z]', ''), r'{SILENT_END}', ''), '^y', ''), '[aeiouy]+')) END",
    ),
    ("prose_words", "text STRING", "ARRAY<STRING>", f"regexp_extract_all(coalesce(text, ''), r\"[{LETTERS}]+(?:['’-][{LETTERS}]+)*\", 0)"),
    ("round1", "x DOUBLE", "DOUBLE", "CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('infinity') THEN 0D ELSE floor(x * 10 + 0.5D) / 10 END"),
    ("ease_label", "flesch DOUBLE", "STRING", "CASE WHEN flesch >= 80 THEN 'Very easy' WHEN flesch >= 60 THEN 'Easy' WHEN flesch >= 50 THEN 'Fairly hard' WHEN flesch >= 30 THEN 'Hard' ELSE 'Very hard' END"),
    ("sentence_band", "words INT", "STRING", "CASE WHEN words <= 8 THEN 'short' WHEN words >= 40 THEN 'veryLong' WHEN words >= 25 THEN 'long' ELSE 'medium' END"),
)


def register_functions(spark: SparkSession) -> SparkSession:
    """Let SQL of this session call ``FUNCTIONS``."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return spark


def register_views(engine: ProseEngine, name: str) -> None:
    """Views ``name_sentences``, ``name_words``, ``name_marks``, ``name_scores`` and ``name_echoes`` of an engine's results."""
    views = {"sentences": engine.sentences, "words": engine.tokens, "marks": engine.marks, "scores": engine.readability, "echoes": engine.echoes()}
    for section, frame in views.items():
        frame.createOrReplaceTempView(f"{name}_{section}")


def register_marks_of(spark: SparkSession, name: str) -> None:
    """``name_marks_of(id, rule)``: a table function of one document's marks of a rule, for SQL that has registered the views."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_marks_of(id BIGINT, wanted STRING) RETURNS TABLE (start INT, stop INT, word STRING) "
        f"RETURN SELECT m.`from`, m.`to`, m.word FROM {name}_marks m WHERE m.doc_id = id AND m.rule = wanted"
    )
