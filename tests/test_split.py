"""Documents in pieces give the marks and sentences of whole ones."""

import random

import pytest

from prosemill.operators import split as S
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions

PROSE = [
    "The nets were slowly torn by rocks, and many boats sank early that day.", "Perhaps it rains — now — or — later, but at the end of the day we delve into it.",
    "It is not just loud, it is near the old harbour wall.", "A long line of of words without any other thing in it stays here.",
]
ODD = [
    "```\nperhaps code\n```", "~~~~\nmaybe\n\n~~~\nmaybe more\n~~~~", "> ~~~\n> quoted perhaps\n> maybe\n\nout of the quote again now.", "$$\nx\n\ny\n$$", "<!-- a\n\nb perhaps -->", "---", "# At the end",
    "of the day", "- [x] item\n- perhaps two", "`tick", "tick` end", "| a | perhaps |", "\tindented perhaps", "~~~", "> ```", "At the end\n\nof the day it rains on", "[a](b\n\n\"c\")", "text ^id",
]


def made(rng, n, front):
    blocks = [("---\nport: perhaps\n\nmaybe: x\n---\n" if front == 1 else "---\nno end\n" if front == 2 else "")]
    for _ in range(n):
        blocks.append(rng.choice(ODD) if rng.random() < 0.12 else " ".join(rng.choice(PROSE) for _ in range(rng.randrange(1, 9))))
    return "\n\n".join(blocks)


def parted(text, rng):
    lines = text.split("\n")
    parts, at = [], 0
    while at < len(lines):
        n = rng.randrange(60, 400)
        parts.append("\n".join(lines[at : at + n]) + ("\n" if at + n < len(lines) else ""))
        at += n
    return parts


@pytest.mark.parametrize("size", [3000, 40000])
def test_pieces_equal_wholes(spark, size):
    rng = random.Random(size)
    texts = [made(rng, 400, k % 3) for k in range(6)] + ["short perhaps", PROSE[0] * 300]
    parts = [(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(parted(t, rng))]
    assert ["".join(p for j, _, p in parts if j == i) for i in range(len(texts))] == texts
    options = RuleOptions(is_pro=True)
    rows = S.split(spark.createDataFrame(parts, "doc_id long, part long, text string").repartition(5), size).cache()
    pieces = rows.groupBy("doc_id.doc_id").count().collect()
    assert max(r["count"] for r in pieces) > (20 if size == 3000 else 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = S.whole(ProseEngine(rows, options).marks), ProseEngine(docs, options).marks

    def key(df):
        return sorted(map(str, (tuple(r[c] for c in ("doc_id", "from", "to", "rule", "severity", "word")) for r in df.collect())))

    assert key(got) == key(want)
    spans = [sorted((r["doc_id"], r["from"], r["to"]) for r in df.collect()) for df in (S.whole(ProseEngine(rows).spans), ProseEngine(docs).spans)]
    assert spans[0] == spans[1]
    rows.unpersist()
