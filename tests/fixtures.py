"""Small fixed tables: Markdown, hedges, phrases, machine prose, edits.

Each case is written once, with what is expected marked in it, and gives both the query's input and, as VALUES, the rows
that the query must return. The texts are this project's own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import signed, singular, web_url, word_at
from prosemill.operators.navigate import map_offset
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions, normalize_settings

#: ``⟦...⟧`` is what the Markdown mask hides.
MASKED = (
    "⟦---\nport: north\n---⟧\nBoats ⟦*⟧rest⟦*⟧ here.",
    "⟦---\nport: south\n...⟧\nA short quay.",
    "⟦---⟧\nno end: here\nBoats rest.",
    "Before.\n\n⟦```sh⟧\n⟦ls -l⟧\n⟦```⟧\nAfter.",
    "⟦~~~~⟧\n⟦one⟧\n⟦~~~⟧\n⟦two⟧\n⟦~~~~⟧\nout",
    "⟦> ~~~⟧\n⟦> in⟧\n\nout again",
    "⟦## A heading⟧\ntext",
    "Title\n⟦=====⟧\ntext\n\n⟦***⟧\n",
    "⟦| a | b |⟧\ntext",
    "⟦\tcode line⟧\n⟦- ⟧item\n⟦1. ⟧item\n⟦- [x] ⟧done",
    "Use ⟦`one`⟧ and ⟦``two ` ticks``⟧ now, not ` this.",
    "Sum ⟦$a + b$⟧ costs $5 or $6.",
    "⟦$$⟧\n⟦x^2⟧\n⟦$$⟧ end",
    "a ⟦<i class='x'>⟧b⟦</i>⟧ c ⟦<!-- d⟧\n⟦e -->⟧ f",
    "See ⟦[[Note|alias]]⟧ and ⟦![[pic.png]]⟧.",
    "Read ⟦[⟧the log⟦](log.md \"x\")⟧ and ⟦![alt](p.png)⟧.",
    "At ⟦https://a.example/b?c=1⟧ or ⟦www.b.example⟧ today",
    "Tag ⟦#sea/north⟧ not #7, note⟦[^1]⟧ end⟦ ^id-1⟧\nx",
    "⟦**⟧bold⟦**⟧ ⟦~~⟧gone⟦~~⟧ ⟦==⟧lit⟦==⟧ snake_case_word",
)
#: ``⟦rule:text⟧`` is a mark of that rule, as the whole engine finds it with every rule on.
RULED = (
    "⟦weasel:Countless⟧ crabs came.", "⟦hedge:Perhaps⟧ it rains.", "⟦hedge:Basically⟧ a boat.", "It sank ⟦adverb:slowly⟧ and ⟦weasel:surely⟧.",
    "An early family trip.", "⟦hedge:It seems⟧ calm.", "The hull is ⟦hedge:sort of⟧ green.", "⟦cliche:At the end of the day⟧ we row.",
    "Go ⟦cliche:back to the drawing board⟧ now.", "The chart is ⟦deslop:a testament to⟧ care.", "They ⟦deslop:embark on a journey⟧ now.",
    "Its lamp is a ⟦deslop:beacon⟧ now.", "Fog ⟦deslop:—⟧ thick ⟦deslop:—⟧ hid ⟦deslop:—⟧ us.", "One — two — three.",
    "He is ⟦deslop:not only quick but also⟧ kind.", "It is ⟦deslop:not just loud, it is⟧ near.", "Row ⟦doubled:to to⟧ land.", "a `b` a c",
    "The net ⟦passive:was torn⟧ here.", "It ⟦passive:has been slowly mended⟧ since.".replace("has ⟦passive:", ""), "They were tired.",
    "They ⟦passive:were frightened⟧ by thunder.", "The bed is red.", "## Perhaps a heading", "`perhaps` a word",
)
RULED = tuple(t.replace("⟦passive:has been", "has ⟦passive:been") for t in RULED)
#: Lines with a cursor ``‸`` in or beside the word that is found there, which is marked.
CURSORS = ("The ⟦har‸bour⟧ wall", "‸⟦Quay⟧ side", "end ⟦here‸⟧", "a ‸ b", "⟦don’t‸⟧ go", "'⟦twas‸⟧' said", "12 ‸3", "")
#: Offset, edits (from, to, inserted length) in order, and where it ends with a left and a right bias.
EDITS = (
    (1, 5, [(0, 0, 3)], 8, 8), (2, 5, [(5, 5, 2)], 5, 7), (3, 5, [(6, 8, 0)], 5, 5), (4, 5, [(2, 4, 1)], 4, 4), (5, 5, [(3, 8, 2)], 3, 5),
    (6, 5, [(0, 1, 0), (4, 4, 2)], 4, 6), (7, 0, [], 0, 0),
)
CHANGES = ((1, 2.0, "+2"), (2, -1.5, "-1.5"), (3, 0.04, "+0"), (4, 10.25, "+10.3"), (5, 0.0, None))
LABELS = ((1, "Adverbs", "Adverb"), (2, "Passive voice", "Passive voice"), (3, "ss", "s"), (4, "", ""))
LINKS = ((1, "https://a.example/x", "https://a.example/x"), (2, "javascript:alert(1)", "-"), (3, "HTTP://B.example", "HTTP://B.example"), (4, "no url", "-"), (5, None, "-"))
#: Stored settings and what they are repaired to: long and very long words, most characters, paid.
SETTINGS = (
    (1, {}, 25, 40, 300000, False), (2, {"longSentenceWords": 99, "veryLongSentenceWords": 3}, 45, 46, 300000, False), (3, {"maxNoteChars": 1, "isPro": True}, 25, 40, 50000, True),
    (4, {"longSentenceWords": "30", "isPro": "yes"}, 25, 40, 300000, False), (5, {"longSentenceWords": 20.5, "veryLongSentenceWords": 1000}, 21, 70, 300000, False),
)


def _unmarked(case: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text without its marks, and the marked spans with what stands before their colon."""
    out, spans, at = "", [], 0
    for m in re.finditer("⟦(?:([A-Za-z]+):(?!/))?(.*?)⟧", case, re.DOTALL):
        out += case[at : m.start()]
        spans.append((len(out), len(out) + len(m[2]), m[1] or ""))
        out += m[2]
        at = m.end()
    return out + case[at:], spans


def _texts(spark: SparkSession, cases: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, _unmarked(c)[0]) for i, c in enumerate(cases)], "doc_id long, text string")


def fixture_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ProseEngine(_texts(spark, MASKED)).masked


def fixture_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ProseEngine(_texts(spark, RULED), RuleOptions(is_pro=True)).marks
    return marks.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"), "rule")


def fixture_words_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, t.replace("‸", ""), max(0, t.find("‸"))) for i, t in enumerate(c.replace("⟦", "").replace("⟧", "") for c in CURSORS)]
    lines = spark.createDataFrame(rows, "line_id long, line string, cursor int")
    return lines.select("line_id", word_at(F.col("line"), F.col("cursor")).alias("word"))


def fixture_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([c[:3] for c in EDITS], "edit_id long, offset int, edits array<struct<from:int,to:int,insert:int>>")
    return rows.select("edit_id", *[map_offset(F.col("offset"), F.col("edits"), b).alias(n) for b, n in ((-1, "to_left"), (1, "to_right"))])


def fixture_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([c[:2] for c in CHANGES], "id long, x double").select(F.lit("signed").alias("kind"), "id", signed(F.col("x")).alias("shown"))
    labels = spark.createDataFrame([c[:2] for c in LABELS], "id long, x string").select(F.lit("singular").alias("kind"), "id", singular(F.col("x")).alias("shown"))
    links = spark.createDataFrame([c[:2] for c in LINKS], "id long, x string").select(F.lit("link").alias("kind"), "id", web_url(F.col("x"), "-").alias("shown"))
    return changes.unionAll(labels).unionAll(links)


def fixture_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, s.long_sentence_words, s.very_long_sentence_words, s.max_note_chars, s.is_pro) for i, s in ((c[0], normalize_settings(c[1])) for c in SETTINGS)]
    return spark.createDataFrame(rows, "id long, long_words int, very_long_words int, most_chars int, paid boolean")


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join("CAST({} AS {}) AS {}".format(c.split()[0], c.split()[1], c.split()[0]) for c in columns.split(", "))
    return f"SELECT {casts} FROM (VALUES {listed}) AS t({', '.join(names)})"


def _hidden(case: str) -> str:
    text, spans = _unmarked(case)
    for a, b, _ in spans:
        text = text[:a] + re.sub("[^\n]", " ", text[a:b]) + text[b:]
    return text


QUERIES = {
    "fixture_masks": fixture_masks, "fixture_marks": fixture_marks, "fixture_words_at": fixture_words_at, "fixture_offsets": fixture_offsets,
    "fixture_formats": fixture_formats, "fixture_settings": fixture_settings,
}
ORACLE_SQL = {
    "fixture_masks": _values("doc_id BIGINT, masked VARCHAR", [(i, _hidden(c)) for i, c in enumerate(MASKED)]),
    "fixture_marks": _values("doc_id BIGINT, start INT, stop INT, rule VARCHAR", [(i, *s) for i, c in enumerate(RULED) for s in _unmarked(c)[1]]),
    "fixture_words_at": _values(
        "line_id BIGINT, word VARCHAR", [(i, (re.findall("⟦(.*)⟧", c) or [None])[0]) for i, c in enumerate(x.replace("‸", "") for x in CURSORS)]
    ),
    "fixture_offsets": _values("edit_id BIGINT, to_left INT, to_right INT", [(i, left, right) for i, _, _, left, right in EDITS]),
    "fixture_formats": _values(
        "kind VARCHAR, id BIGINT, shown VARCHAR",
        [(k, i, shown) for k, rows in (("signed", CHANGES), ("singular", LABELS), ("link", LINKS)) for i, _, shown in rows],
    ),
    "fixture_settings": _values(
        "id BIGINT, long_words INT, very_long_words INT, most_chars INT, paid BOOLEAN", [(c[0], *c[2:]) for c in SETTINGS]
    ),
}
