"""Markdown notes planted with every construct and every rule, made from each row of ``documents``, in Spark and in SQL alike.

A template has what is masked, or marked, in double brackets and places for the document's own words, so that lengths and
offsets differ from row to row; SQL builds what is expected from the same templates and never looks for a construct.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import split
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RULES, RuleOptions

#: ``{w}`` is a word of the document, in letters that no rule knows; ``{t}`` all its letters. ``⟦...⟧`` is what the mask hides.
FRONT = ("⟦---\n{w}: north\n---⟧\nBoats ⟦*⟧{w}⟦*⟧ here.", "⟦---\nport: {w}\n...⟧\nA short {w}.", "⟦---⟧\nno end: {w}\nBoats rest.")
MASKED = (
    "Before {w}.", "⟦```sh⟧\n⟦{t}⟧\n⟦```⟧\nAfter {w}.", "⟦~~~~⟧\n⟦{w}⟧\n⟦~~~⟧\n⟦two⟧\n⟦~~~~⟧\nout {w}", "⟦> ~~~⟧\n⟦> {w}⟧", "out again {t}", "⟦## A {w} heading⟧\ntext", "{w}\n⟦=====⟧\ntext",
    "⟦***⟧", "⟦| {w} | b |⟧\ntext", "⟦\tcode {w}⟧\n⟦- ⟧item\n⟦1. ⟧{w}\n⟦- [x] ⟧done", "Use ⟦`{w}`⟧ and ⟦``two ` {w}``⟧ now, not ` this.", "Sum ⟦$a + {w}$⟧ costs $5 or $6.",
    "⟦$$⟧\n⟦{w}^2⟧\n⟦$$⟧ end", "{w} ⟦<i class='{w}'>⟧b⟦</i>⟧ c ⟦<!-- {w}⟧\n⟦e -->⟧ f", "See ⟦[[Note|{w}]]⟧ and ⟦![[{w}.png]]⟧.", "Read ⟦[⟧the {w}⟦]({w}.md \"x\")⟧ and ⟦![{w}](p.png)⟧.",
    "At ⟦https://{w}.example/b?c=1⟧ or ⟦www.{w}.example⟧ today", "Tag ⟦#sea/{w}⟧ not #7, note⟦[^{w}]⟧ end⟦ ^{w}⟧\nx", "⟦**⟧{w}⟦**⟧ ⟦~~⟧gone⟦~~⟧ ⟦==⟧lit⟦==⟧ snake_{w}_case",
    "⟦> ⟧quoted {w}", "⟦> 1) ⟧{w}", "⟦___⟧",
)
#: ``⟦rule:text⟧`` is a mark of that rule, as the whole engine finds it with every rule on.
RULED = (
    "{w} saw ⟦weasel:countless⟧ crabs.", "⟦hedge:Perhaps⟧ {w} rains.", "⟦hedge:Basically⟧ a {w}.", "{w} sank ⟦adverb:slowly⟧ and ⟦weasel:surely⟧.", "An early {w} family trip.",
    "⟦hedge:It seems⟧ {w}.", "The {w} is ⟦hedge:sort of⟧ green.", "⟦cliche:At the end of the day⟧ {w} rows.", "Go ⟦cliche:back to the drawing board⟧, {w}.", "The {w} is ⟦deslop:a testament to⟧ care.",
    "{w} will ⟦deslop:embark on a journey⟧ now.", "Its {w} is a ⟦deslop:beacon⟧ now.", "Fog ⟦deslop:—⟧ {w} ⟦deslop:—⟧ hid ⟦deslop:—⟧ us.", "One — {w} — three.",
    "{w} is ⟦deslop:not only quick but also⟧ kind.", "It is ⟦deslop:not just {w}, it is⟧ near.", "Row ⟦doubled:{w} {w}⟧ home.", "{w} `{w}` {w} c", "The {w} ⟦passive:was torn⟧ here.",
    "It has ⟦passive:been slowly mended⟧ since {w}.", "The {w} must ⟦passive:be hidden⟧.", "{w} were tired.", "They ⟦passive:were frightened⟧ by {w}.", "The {w} ⟦passive:got stuck⟧ there.", "The {w} is red.",
    "## Perhaps a {w}", "`perhaps` a {w}", "```\nperhaps {t}\n```", "⟦longSentence:" + "a {w} " * 13 + "went.⟧", "The ⟦adverb:boldly⟧ {w} thing.", "A {w} (⟦hedge:maybe⟧) came.",
)
FULL = RuleOptions(is_pro=True)
#: Characters of a piece of a note, about.
PIECE = 300
_PART = re.compile(r"⟦(?:([A-Za-z]+):(?!/))?|⟧|\{w\}|\{t\}|[^⟦⟧{]+")


def pieces(template: str) -> list[tuple[str, str | None]]:
    """(text or place, what it is in): ``None`` outside brackets, else the rule, which is empty for the mask."""
    out, inside = [], None
    for m in _PART.finditer(template):
        if m[0].startswith("⟦"):
            inside = m[1] or ""
        elif m[0] == "⟧":
            inside = None
        else:
            out.append((m[0], inside))
    return out


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``w`` and ``t`` of every document; a null text gives an empty ``t``."""
    text = F.coalesce("text", F.lit(""))
    word = F.concat(F.lit("zq"), F.lower(F.regexp_extract(text, "[A-Za-z]{1,12}", 0)), F.lit("k"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", word.alias("w"), F.trim(F.regexp_replace(text, "[^A-Za-z]+", " ")).alias("t"))


WORDS_SQL = """SELECT doc_id, 'zq' || lower(regexp_extract(coalesce(text, ''), '[A-Za-z]{1,12}')) || 'k' AS w,
  trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS t FROM documents"""


def _note(templates: tuple[str, ...]) -> Column:
    places = {"{w}": F.col("w"), "{t}": F.col("t")}
    return F.concat(*[places[text] if text in places else F.lit(text) for text, _ in pieces("\n\n".join(templates))])


def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.pmod("doc_id", F.lit(len(FRONT)))
    kinds = [_note((front, *MASKED)) for front in FRONT]
    return own_words(spark, sf_dir).select("doc_id", F.when(own == 0, kinds[0]).when(own == 1, kinds[1]).otherwise(kinds[2]).alias("text"))


def ruled_notes(spark: SparkSession, sf_dir: str) -> ProseEngine:
    return ProseEngine(own_words(spark, sf_dir).select("doc_id", _note(RULED).alias("text")), FULL)


def planted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ProseEngine(masked_notes(spark, sf_dir)).masked


def planted_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled_notes(spark, sf_dir).marks.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"), "rule")


def planted_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of the same notes, each cut into pieces that are analysed one by one."""
    notes = own_words(spark, sf_dir).select("doc_id", F.lit(0).cast("long").alias("part"), _note(RULED).alias("text"))
    found = split.whole(ProseEngine(split.split(notes, PIECE), FULL).marks)
    return found.select("doc_id", F.col("from").cast("int").alias("start"), F.col("to").cast("int").alias("stop"), "rule")


def planted_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many marks of each class a note shows."""
    return ruled_notes(spark, sf_dir).painted().groupBy("doc_id", "css_class").agg(F.count("*").alias("n"))


def planted_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled_notes(spark, sf_dir).legend().select("doc_id", "rule", "name", "n", "total")


def planted_machine_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled_notes(spark, sf_dir).machine_prose_count()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _masked_sql(templates: tuple[str, ...]) -> str:
    def shown(text: str, inside: str | None) -> str:
        if text in ("{w}", "{t}"):
            return text[1] if inside is None else f"repeat(' ', length({text[1]}))"
        return _quoted(text if inside is None else re.sub("[^\n]", " ", text))

    return " || ".join(shown(*p) for p in pieces("\n\n".join(templates)))


def _spans(templates: tuple[str, ...]) -> list[tuple[str, list[int], list[int]]]:
    """(rule, start, stop) of each mark; places are numbers of characters, of ``w`` and of ``t``."""
    out, at, last = [], [0, 0, 0], None
    for text, inside in pieces("\n\n".join(templates)):
        before = list(at)
        place = {"{w}": 1, "{t}": 2}.get(text, 0)
        at[place] += 1 if place else len(text)
        if inside:
            if last and inside == last[0] and before == last[2]:
                last[2][:] = at
            else:
                last = (inside, before, list(at))
                out.append(last)
        else:
            last = None
    return out


def _counts() -> dict[str, int]:
    found = [rule for rule, _, _ in _spans(RULED)]
    return {rule: found.count(rule) for rule in RULES}


def _values(rows: list[tuple], names: str) -> str:
    listed = ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {listed}) AS v({names})"


def _painted_sql() -> str:
    quiet = {"passive": "pl-mark pl-passive pl-quiet"}  # after a modal
    classes: dict[str, int] = {}
    text = "\n\n".join(RULED)
    for rule, n in _counts().items():
        modal = text.count("must ⟦passive:") if rule == "passive" else 0
        for name, k in ((RULES[rule][1], n - modal), (quiet.get(rule, ""), modal)):
            if k:
                classes[name] = classes.get(name, 0) + k
    return f"SELECT doc_id, css_class, n::BIGINT AS n FROM documents CROSS JOIN {_values(list(classes.items()), 'css_class, n')}"


_PLACES = "{0}0 + {0}1 * length(w) + {0}2 * length(t)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "planted_masks": planted_masks, "planted_marks": planted_marks, "planted_pieces": planted_pieces, "planted_painted": planted_painted, "planted_legend": planted_legend,
    "planted_machine_prose": planted_machine_prose,
}
ORACLE_SQL = {
    "planted_masks": f"SELECT doc_id, CASE doc_id % {len(FRONT)} "
    + " ".join(f"WHEN {i} THEN {_masked_sql((front, *MASKED))}" for i, front in enumerate(FRONT))
    + f" END AS masked FROM ({WORDS_SQL})",
    "planted_marks": f"SELECT doc_id, ({_PLACES.format('a')})::INT AS start, ({_PLACES.format('b')})::INT AS stop, rule FROM ({WORDS_SQL}) CROSS JOIN "
    + _values([(rule, *a, *b) for rule, a, b in _spans(RULED)], "rule, a0, a1, a2, b0, b1, b2"),
    "planted_painted": _painted_sql(),
    "planted_legend": f"SELECT doc_id, rule, name, n::BIGINT AS n, {sum(_counts().values())}::BIGINT AS total FROM documents CROSS JOIN "
    + _values([(rule, RULES[rule][0], n) for rule, n in _counts().items()], "rule, name, n"),
    "planted_machine_prose": f"SELECT doc_id, {_counts()['deslop']}::BIGINT AS n FROM documents",
}
ORACLE_SQL["planted_pieces"] = ORACLE_SQL["planted_marks"]
