"""What the scan knows without looking: endings of unlisted words, texts of common code points, texts without any sign of a construct."""

import random
import re

from prosemill.functions import lexicons as L
from prosemill.operators import mask as M
from prosemill.operators import segment as G
from prosemill.operators import words as W

SILENT_END = re.compile("(?:[^laeiouy]es|[^taeiouyd]ed|[^laeiouy]e)$")


def test_words_by_their_ending():
    rng = random.Random(2)
    words = {"".join(rng.choice("aeiouylstdkr'’é") for _ in range(rng.randrange(1, 8))) for _ in range(30_000)} | {w + e for w in L.WEASELS + L.NOT_ADVERBS for e in ("", "ly", "ed", "’s")}
    for word in words:
        assert W.kinds(word) == W._listed_kinds(word), word
        plain = re.sub("[^a-z]", "", word)
        spoken = re.sub("^y", "", SILENT_END.sub("", plain))
        assert W.syllables(word) == (int(bool(plain)) if len(plain) <= 3 else max(1, len(re.findall("[aeiouy]+", spoken)))), word


def test_sentences_of_common_code_points():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB3é. !?…”\"),:;\n\r\u0085ªЖ中。­–") for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    assert [G.sentence_ends(t) for t in texts] == [_by_classes(t) for t in texts]


def _by_classes(text: str) -> list[int]:
    places = [i for i, c in enumerate(text) if i == 0 or G._CLASSES[ord(c)] != "I"]
    classes = "".join(G._CLASSES[ord(text[i])] or "I" for i in places)
    ends = []
    for m in re.finditer("([AT])(C*)(S*)(P?)|P", classes):
        after = classes[m.end() : m.end() + 1]
        if m[1] and not m[4]:
            near = not m[2] and not m[3] and (after == "N" or (after == "U" and classes[: m.start()][-1:] in ("U", "L")))
            if after in ("K", "A", "T") or (m[1] == "A" and (near or re.match("[^OULPAT]*L", classes[m.end() :]))):
                continue
        if m.end() < len(classes):
            ends.append(places[m.end()])
    return [*ends, len(text)]


def test_plain_prose_is_searched_for_no_construct(monkeypatch):
    class Never:
        def finditer(self, text):
            raise AssertionError("searched")

    text = "The nets were torn by rocks, and many boats sank early that day.\n" * 10
    monkeypatch.setattr(M, "_HOLDS", [(Never(), signs) for _, signs in M._HOLDS])
    for name in ("TAG", "LINK", "EMPHASIS", "TICKS"):
        monkeypatch.setattr(M, name, Never())
    assert M.solid_text(text) == text
