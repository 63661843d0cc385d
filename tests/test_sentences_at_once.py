"""Blocks and sentences of many texts at once: the same as one text after another, and usual texts are not looked at one by one."""

import random

from prosemill.operators import scan as S
from prosemill.operators import sentences as N

PIECES = ["A", "b", "é", "Ж", "中", "3", " ", "  ", "\n", "\n\n", ". ", ".", "! ", "?", "…", "”", ")", '"', ",", ":", "- x\n", "1. ", "# ", "> ", "|", "[ ] ", "　", " ", "\x1c", "🎯"]
ODD = ["­", "́", "\r", "\x85", " ", "﻿"]


def test_sentences_of_many_texts():
    rng = random.Random(6)
    for pieces in (PIECES, PIECES + ODD):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(6000)]
        masks = ["".join(" " if c != "\n" and rng.random() < 0.05 else c for c in text) for text in texts]
        for some, seen in ((texts, masks), (texts, texts), (texts[:1], masks[:1]), (["", "A. B", ""], ["", "A. B", ""]), ([""], [""]), ([], [])):
            for unicode in (True, False):
                offsets, froms, tos = N.sentences_of(some, seen, unicode)
                for d, (text, masked) in enumerate(zip(some, seen)):
                    own = slice(offsets[d], offsets[d + 1])
                    assert (froms[own].tolist(), tos[own].tolist()) == N.sentence_spans(masked, N.block_spans(text, masked), unicode), (text, masked)
                assert len(offsets) == len(some) + 1 and offsets[-1] == len(froms) == len(tos)


def test_usual_texts_are_judged_together(monkeypatch):
    def never(*args):
        raise AssertionError("one by one")

    monkeypatch.setattr(N, "block_spans", never)
    monkeypatch.setattr(N, "sentence_spans", never)
    texts = ["Nets were torn. Boats sank.\n- Two\n\nÉté at 3.5 knots.", ""]
    found = S.Scanner(("sent_text",))._found(texts, S.Trie(()), None, None, None)["sent_text"].to_pylist()
    assert found == [["Nets were torn.", "Boats sank.", "Two", "Été at 3.5 knots."], []]
