"""Sentences to rules: every case of a table runs in one plan for each segmenter."""

import pytest

from prosemill.operators.segment import sentence_ends
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions

LONG = "Boat after boat " * 9 + "came in."
DASHED = "Fog — thick fog — hid the pier — and the light — from us."
FIRES = [
    ("adverb", "Gulls circled lazily above us."), ("adverb", "The tide turned silently."), ("passive", "Two nets were torn by the rocks."),
    ("passive", "The oars have been stolen."), ("passive", "Our anchor got stuck."), ("passive", "Each plank was slowly sanded."),
    ("hedge", "Perhaps the wind drops."), ("hedge", "It seems the pilot left."), ("hedge", "The hull is sort of green."),
    ("weasel", "Countless crabs came ashore."), ("weasel", "The fog was remarkably thick."), ("doubled", "Row to to the island."), ("doubled", "The The mast broke."),
    ("cliche", "Only time will tell who lands first."), ("cliche", "We left no stone, so leave no stone unturned."), ("cliche", "Sailing is easier said than done."),
    ("deslop", "They embark on a journey tonight."), ("deslop", "Its lamp is a beacon."), ("deslop", "The chart is a testament to patience."),
    ("deslop", "The storm is not just loud, it is near."), ("deslop", "He mended not only the sail but also the rudder."), ("deslop", DASHED),
    ("longSentence", LONG), ("passive", "One ` mark here and the buoy was quietly moved."), ("doubled", "Cut to the the chase."),
    ("passive", "The crew was frightened by thunder."), ("passive", "The lamps weren’t stolen."),
]
SILENT = [
    ("adverb", "An elderly dragonfly sat early in July."), ("adverb", "Fly fishing is costly."), ("passive", "The sailors were exhausted."),
    ("passive", "They were satisfied by then."), ("passive", "The captain is sailing."), ("passive", "The mate is Lee, hired elsewhere."),
    ("passive", "The rope was" + " " * 15 + "coiled."), ("passive", "It was speed that counted."), ("doubled", "a `knot` a rope"), ("doubled", "a $k$ a rope"),
    ("deslop", "The mate — half asleep — nodded."), ("deslop", "He did not just row. But he sang."), ("hedge", "## Perhaps, a ship"),
    ("cliche", "Easier said `x` than done."), ("weasel", "A ship needs ballast."),
]
HOSTILE = """---
log: many nets were obviously torn
---

## Countless nets were badly torn

~~~sh
echo "the hull was hugely dented" # really
~~~

The key `was_quickly_turned`, the sum $t = was_slowly_added$ and [[Nets that were mended]] at
www.nets.example/was-clearly-mended

| net | the net was surely mended |
|---|---|
"""
NOTHING = [HOSTILE, "> ~~~\n> nets = really(torn)\n> ~~~\n", "2) Run it:\n\n    ~~~\n    - nets: were clearly torn\n    ~~~\n", "", " \n\t\n", None]


@pytest.mark.parametrize("segmenter", ["unicode", "regex"])
def test_rules(spark, segmenter):
    texts = [t for _, t in FIRES] + [t for _, t in SILENT] + NOTHING
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found: dict[int, list] = {}
    for m in ProseEngine(docs, RuleOptions(is_pro=True), segmenter=segmenter).marks.collect():
        found.setdefault(m["doc_id"], []).append(m)
        assert 0 <= m["from"] < m["to"] <= len(texts[m["doc_id"]])
        if m["word"] is not None and m["rule"] != "doubled":
            assert texts[m["doc_id"]][m["from"] : m["to"]].lower().replace("’", "'").split() == m["word"].split()
    rules = {i: {m["rule"] for m in ms} for i, ms in found.items()}
    for i, (rule, text) in enumerate(FIRES):
        assert rule in rules.get(i, ()), (rule, text)
    for i, (rule, text) in enumerate(SILENT, len(FIRES)):
        assert rule not in rules.get(i, ()), (rule, text)
    for i in range(len(FIRES) + len(SILENT), len(texts)):
        assert i not in found
    dashes = [m for m in found[texts.index(DASHED)] if m["rule"] == "deslop"]
    assert [m["severity"] for m in dashes] == ["info"] * 4


def test_options(spark):
    texts = ["Gulls lazily rose and silently left.", "The nets were torn.", "The lamp must be hidden.", "Surely it rains.", "Its lamp is a beacon.", "The hull was badly dented."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def marks(**options):
        rows = ProseEngine(docs, RuleOptions(**options), segmenter="regex").marks.orderBy("doc_id", "from").collect()
        return [(m["doc_id"], m["rule"], m["severity"], m["word"]) for m in rows]

    assert marks() == [
        (0, "adverb", "info", "lazily"), (0, "adverb", "info", "silently"), (1, "passive", "warn", None), (2, "passive", "info", None),
        (3, "weasel", "info", "surely"), (5, "passive", "warn", None),
    ]
    assert [m[3] for m in marks(ignored_words=(" Lazily ", "torn", "")) if m[0] == 0] == ["silently"]
    off = marks(rules={"passive": False, "weasel": False})
    assert [m for m in off if m[0] in (3, 5)] == [(3, "adverb", "info", "surely"), (5, "adverb", "info", "badly")]
    assert marks(rules=dict.fromkeys("adverb passive hedge weasel doubled cliche longSentence deslop".split(), False)) == []


SENTENCES = [
    ("Low water came early. The boats lay still! Who moved them?", [4, 4, 3]), ("Nets dry\nin the wind\nall day long.", [8]),
    ("* cast off\n* set sail\n* steer north", [2, 2, 2]), ("The quay\nis long.\n\nIt ends here.", [4, 3]),
    ("Before the log.\n\n~~~\nlog = []\n~~~\n\nAfter it.", [3, 2]), ("~~~\nonly code\n~~~", []), ("+ rope\nloose line of words\nthat goes on", [1, 7]),
    ("oar " * 2500, [2500]), ("", []), (None, []),
]


@pytest.mark.parametrize("segmenter", ["unicode", "regex"])
def test_sentences(spark, segmenter):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "doc_id long, text string")
    engine = ProseEngine(docs, segmenter=segmenter)
    got: dict[int, list[int]] = {}
    for s in engine.sentences.orderBy("doc_id", "sent_idx").collect():
        got.setdefault(s["doc_id"], []).append(s["words"])
        assert SENTENCES[s["doc_id"]][0][s["from"] : s["to"]].replace("\n", " ") == s["text"]
    assert [got.get(i, []) for i in range(len(SENTENCES))] == [w for _, w in SENTENCES]
    stats = {r["doc_id"]: r for r in engine.stats.collect()}
    assert len(stats) == len(SENTENCES)
    assert (stats[8]["words"], stats[8]["sentences"], stats[8]["grade"], stats[8]["counts"]) == (0, 0, 0.0, {})
    assert stats[0]["avgSentenceWords"] == 3.7 and stats[0]["longestSentenceWords"] == 4


def test_sentence_rules_match_the_jvm(spark):
    import random

    icu = spark._jvm.com.ibm.icu.text.BreakIterator
    english = spark._jvm.java.util.Locale.ENGLISH
    rng = random.Random(4)
    parts = [*"aB. !?,;:\"')(1—…é日", ". ", "e.g. ", "Dr. ", ' "', "3.4"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(40))
        it = icu.getSentenceInstance(english)
        it.setText(text)
        ends = []
        while (end := it.next()) != -1:
            ends.append(end)
        assert sentence_ends(text) == ends, text
