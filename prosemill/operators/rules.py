"""Rules: each turns the arrays of a scanned document into candidate marks.

Every rule is an expression over a document's row, so that one pass over the documents finds all marks and only marks leave it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import lexicons as L
from prosemill.functions.arrays import each, positions, running
from prosemill.operators.scan import CLOSE, FIRST, PLAIN, TIGHT, WORD, Phrase
from prosemill.operators.words import Kind
from prosemill.plans.options import RuleOptions

# Messages of the rules.
MESSAGES = {
    "weasel": "Weasel word — say who, or how many",
    "hedge": "Hedge — it weakens the claim",
    "cliche": "Cliche — the reader skips it",
    "adverb": "Adverb — a stronger verb usually beats one",
    "doubled": "Doubled word",
    "passive": "Passive voice — name who did it",
    "passive modal": "Passive voice — fine in instructions, but naming who acts is stronger",
    "deslop": "Common in machine-generated prose",
    "dash": "Em dash pile-up is a machine-prose tell",
    "reframe": 'The "not just X, it\'s Y" reframing is a machine-prose tell',
}
MARKS = "array<struct<from:int,to:int,rule:string,severity:string,message:string,word:string,seq:int>>"
#: What the rules read of a scan.
WORD_FIELDS = ("near_from", "near_to", "near_lower", "near_kind", "near_gap")
SENTENCE_FIELDS = ("sent_from", "sent_to", "words")
PHRASE_FIELDS = ("phrases",)
MACHINE_FIELDS = ("phrases", "dashes", "reframes")


def _mark(low: Column, high: Column, rule: Column | str, severity: Column | str, message: Column | str, word: Column | None, seq: Column | int) -> Column:
    def column(x: Column | str | int) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        low.cast("int").alias("from"), high.cast("int").alias("to"), column(rule).alias("rule"), column(severity).alias("severity"),
        column(message).alias("message"), (F.lit(None).cast("string") if word is None else word).alias("word"), column(seq).alias("seq"),
    )


def _at(name: str, i: Column) -> Column:
    return F.get(F.col(name), i)


def _is(i: Column, kind: Kind) -> Column:
    """Whether the word at a place is of any of these kinds; false beyond the ends."""
    return F.coalesce(_at("near_kind", i).bitwiseAND(F.lit(int(kind))) != 0, F.lit(False))


def _follows(i: Column, gap: int) -> Column:
    """Whether the word at a place follows one of its own sentence after such a gap."""
    return F.coalesce(_at("near_gap", i).bitwiseAND(F.lit(gap | FIRST)) == gap, F.lit(False))


def long_marks(options: RuleOptions) -> Column:
    def words(i: Column) -> Column:
        return _at("words", i)

    least = min(options.long_words, options.very_long_words)

    def mark(i: Column) -> Column:
        very = words(i) >= options.very_long_words
        message = F.when(very, F.format_string("Very long sentence (%d words) — hard to read in one pass", words(i))).otherwise(
            F.format_string("Long sentence (%d words)", words(i))
        )
        return _mark(_at("sent_from", i), _at("sent_to", i), "longSentence", F.when(very, "strong").otherwise("warn"), message, None, 0)

    return F.transform(F.filter(positions(F.col("words")), lambda i: words(i) >= least), mark)


def lexical_marks(options: RuleOptions) -> Column | None:
    """At most one of weasel, hedge and adverb for each word, in that order among the enabled rules."""
    tests = [(rule, kind) for rule, kind in (("weasel", Kind.WEASEL), ("hedge", Kind.HEDGE), ("adverb", Kind.LY)) if options.enabled(rule)]
    if not tests:
        return None

    def mark(i: Column) -> Column:
        def chosen(values: dict[str, str]) -> Column:
            *others, last = tests
            return reduce(lambda w, t: w.when(_is(i, t[1]), values[t[0]]), others, F.when(F.lit(False), "")).otherwise(values[last[0]])

        return _mark(_at("near_from", i), _at("near_to", i), chosen({r: r for r, _ in tests}), "info", chosen(MESSAGES), _at("near_lower", i), 1)

    wanted = reduce(lambda a, b: a | b, [kind for _, kind in tests])
    return F.transform(F.filter(positions(F.col("near_kind")), lambda i: _is(i, wanted)), mark)


def doubled_marks() -> Column:
    """A word repeated in its sentence with only white space of the original text between."""

    def again(i: Column) -> Column:
        return _follows(i, PLAIN) & (_at("near_lower", i) == _at("near_lower", i - 1))

    def mark(i: Column) -> Column:
        return _mark(_at("near_from", i - 1), _at("near_to", i), "doubled", "warn", MESSAGES["doubled"], _at("near_lower", i), 1)

    return F.transform(F.filter(positions(F.col("near_gap"), 1), again), mark)


def _greedy(items: Column, kind: str) -> Column:
    """Items (first, last, ...) kept from left to right, each starting after the one kept before it has ended."""

    def fits(end: Column, x: Column) -> Column:
        return x["first"] > end

    kept = running(items, F.lit(-1), lambda end, x: F.when(fits(end, x), x["last"]).otherwise(end), lambda end, x: F.when(fits(end, x), x), kind)
    return F.filter(kept, lambda x: x.isNotNull())


def with_passive(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``_passive``: constructions (first, last) before the greedy choice.

    A form of be or get, up to two adverbs, then a participle, all close together. An adjective in -ed ends the search unless
    an agent follows.
    """

    def last(i: Column) -> Column:
        def agent(k: int) -> Column:
            return _follows(i + (k + 1), TIGHT) & _is(i + (k + 1), Kind.BY) & _follows(i + (k + 2), TIGHT) & _is(i + (k + 2), Kind.AGENT)

        def reach(k: int) -> Column:
            verb = _is(i + k, Kind.PARTICIPLE)
            here = F.when(verb, F.when(~_is(i + k, Kind.ADJECTIVE) | agent(k), i + k))
            return F.when(_follows(i + k, TIGHT), here if k == 3 else here.when(_is(i + k, Kind.BETWEEN), reach(k + 1)))

        return reach(1)

    heads = F.filter(positions(F.col("near_kind")), lambda i: _is(i, Kind.AUXILIARY))
    found = F.filter(F.transform(heads, lambda i: F.struct(i.alias("first"), last(i).alias("last"))), lambda x: x["last"].isNotNull())
    return scanned.withColumn("_passive", found)


def passive_marks() -> Column:
    """Marks of the constructions; those that begin inside one already found are left out."""
    items = F.col("_passive")
    crossing = F.exists(positions(items, 1), lambda k: F.get(items, k)["first"] <= F.get(items, k - 1)["last"])
    kept = F.when(crossing, _greedy(items, "array<struct<first:int,last:int>>")).otherwise(items)

    def mark(x: Column) -> Column:
        i = x["first"]
        modal = (_at("near_gap", i).bitwiseAND(F.lit(FIRST)) == 0) & _is(i - 1, Kind.MODAL)
        message = F.when(modal, MESSAGES["passive modal"]).otherwise(MESSAGES["passive"])
        return _mark(_at("near_from", i), _at("near_to", x["last"]), "passive", F.when(modal, "info").otherwise("warn"), message, None, 2)

    return F.transform(kept, mark)


def phrase_table(options: RuleOptions) -> tuple[Phrase, ...]:
    """Hedging phrases and cliches, and words and phrases of machine prose, as far as the options allow."""
    table = [Phrase(p, "hedge", "info", False) for p in L.HEDGE_PHRASES if options.enabled("hedge")]
    table += [Phrase(p, "cliche", "info", False) for p in L.CLICHES if options.enabled("cliche")]
    return (*table, *(machine_table() if options.enabled("deslop") else ()))


def machine_table() -> tuple[Phrase, ...]:
    entries: dict[str, str] = {}
    for severity, source in (("warn", L.MACHINE_PHRASES), ("info", L.MACHINE_WORDS)):
        for entry in source:
            entries.setdefault(" ".join(WORD.findall(entry.lower().replace("’", "'"))), severity)
    return tuple(Phrase(p, "deslop", severity, True) for p, severity in entries.items())


def phrase_marks() -> Column:
    def mark(p: Column) -> Column:
        message = F.when(p["rule"] == "hedge", MESSAGES["hedge"]).when(p["rule"] == "cliche", MESSAGES["cliche"]).otherwise(MESSAGES["deslop"])
        return _mark(p["from"], p["to"], p["rule"], p["severity"], message, p["word"], F.when(p["folded"], 4).otherwise(3))

    return F.transform("phrases", mark)


def dash_marks() -> Column:
    """Every em dash of a sentence that has three or more: dashes are in order, so some three in a row hold it."""
    dashes = F.col("dashes")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get(dashes, a)["sent"] == F.get(dashes, b)["sent"], F.lit(False))

    piled = F.filter(positions(dashes), lambda k: same(k, k + 2) | same(k - 1, k + 1) | same(k - 2, k))
    return F.transform(piled, lambda k: _mark(F.get(dashes, k)["at"], F.get(dashes, k)["at"] + 1, "deslop", "info", MESSAGES["dash"], None, 5))


def reframe_marks() -> Column:
    return F.transform("reframes", lambda x: _mark(x["from"], x["to"], "deslop", "warn", MESSAGES["reframe"], None, 6))


def fields(options: RuleOptions) -> tuple[str, ...]:
    """What the enabled rules read of a scan."""
    found: list[str] = []
    if any(map(options.enabled, ("weasel", "hedge", "adverb", "doubled", "passive"))):
        found += WORD_FIELDS
    if any(map(options.enabled, ("longSentence", "doubled", "passive"))):
        found += SENTENCE_FIELDS
    if any(map(options.enabled, ("hedge", "cliche", "deslop"))):
        found += PHRASE_FIELDS
    if options.enabled("deslop"):
        found += MACHINE_FIELDS
    return tuple(dict.fromkeys(found))


def with_marks(scanned: DataFrame, options: RuleOptions) -> DataFrame:
    """``scanned`` with ``marks``: the enabled rules' candidates as one array; rules that are off are not planned at all."""
    parts = []
    if options.enabled("longSentence"):
        parts.append(long_marks(options))
    if (lexical := lexical_marks(options)) is not None:
        parts.append(lexical)
    if options.enabled("doubled"):
        parts.append(doubled_marks())
    if options.enabled("passive"):
        scanned = with_passive(scanned)
        parts.append(passive_marks())
    if any(map(options.enabled, ("hedge", "cliche", "deslop"))):
        parts.append(phrase_marks())
    if options.enabled("deslop"):
        parts += [dash_marks(), reframe_marks()]
    none = F.array().cast(MARKS)
    return scanned.withColumn("marks", F.concat(none, *[F.coalesce(p.cast(MARKS), none) for p in parts]))


def rows(scanned: DataFrame, marks: Column | str = "marks") -> DataFrame:
    """A row for each mark of an array."""
    return each(scanned, ["doc_id"], marks)


def machine_count() -> Column:
    """Candidates of machine prose in a document's row."""
    return F.size(F.filter("phrases", lambda p: p["folded"])) + F.size(dash_marks()) + F.size("reframes")
