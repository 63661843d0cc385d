"""Masked parts are hidden at once, and lines inside a fence are not looked at one by one."""

import random

from prosemill.operators import mask as M


def test_parts_hidden_at_once():
    rng = random.Random(5)
    for signs in ("aZ9 \t\n\r\x0b\x0c\x1c\x85\xa0é×ÿ", "aZ9 \t\n\r\xa0éЖ中🎯  ﻿"):
        for _ in range(3000):
            part = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
            assert M.hidden(part) == M.BLANK.sub(" ", M.SOLID.sub(M.HOLE, part)), part


def test_fenced_lines_are_passed_over(monkeypatch):
    seen = []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, *args):
            seen.append(args)
            return self.pattern.match(*args)

    class Never:
        def sub(self, *args):
            raise AssertionError("character by character")

    monkeypatch.setattr(M, "CONTEXT", Counting(M.CONTEXT))
    monkeypatch.setattr(M, "SOLID", Never())
    text = "Before.\n" * 50 + "```\n" + "fenced wörds\n" * 50 + "```\nAfter."
    assert M.solid_text(text).replace(M.HOLE, "") == "Before.\n" * 50 + "\n" + " \n" * 50 + "\nAfter."
    assert len(seen) <= 4
