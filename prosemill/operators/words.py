"""What is known of a word by itself: one number of bits for each distinct word, and its syllables."""

from __future__ import annotations

import re
from enum import IntFlag, auto
from itertools import chain

from prosemill.functions import lexicons as L


class Kind(IntFlag):
    """Bits of a word. LY: a word in -ly that is an adverb; AGENT: may follow "by" as who did it."""

    WEASEL = auto()
    HEDGE = auto()
    LY = auto()
    AUXILIARY = auto()
    MODAL = auto()
    PARTICIPLE = auto()
    ADJECTIVE = auto()
    BETWEEN = auto()
    BY = auto()
    AGENT = auto()
    STOP = auto()


CURLY = str.maketrans("’‘", "''")
GROUPS = str.maketrans({c: "a" if c in "aeiouy" else " " for c in map(chr, range(97, 123))})
OTHER = re.compile("[^a-z]")
_STOPS, _WEASELS, _HEDGES, _NOT_ADVERBS = map(frozenset, (L.STOPWORDS, L.WEASELS, L.HEDGES, L.NOT_ADVERBS))
_AUXILIARIES, _MODALS, _BETWEEN = map(frozenset, ((*L.BE_FORMS, *L.GET_FORMS), L.MODALS, L.BETWEEN))
_IRREGULAR, _NOT_PARTICIPLES, _ADJECTIVES, _NOT_AGENTS = map(frozenset, (L.IRREGULAR_PARTICIPLES, L.NOT_PARTICIPLES, L.ED_ADJECTIVES, L.NOT_AGENTS))


def base_form(word: str) -> str:
    """The part before the first plain apostrophe, else before the first typographic one, if there is one."""
    cut = word.find("'") if "'" in word else word.find("’")
    return word[:cut] if cut > 0 else word


LISTED = frozenset(chain(_STOPS, _WEASELS, _HEDGES, _NOT_ADVERBS, _AUXILIARIES, _MODALS, _BETWEEN, _IRREGULAR, _NOT_PARTICIPLES, _ADJECTIVES, _NOT_AGENTS, ("by",)))
_ENDS_LY, _ENDS_ED, OTHERS = (int(x | Kind.AGENT) for x in (Kind.LY | Kind.BETWEEN, Kind.PARTICIPLE, Kind(0)))


def kinds(word: str) -> int:
    """The bits of a word in lower case. Those of the passive look at it with plain apostrophes.

    Of a word that is in no list, and has no apostrophe, only the ending counts.
    """
    if word in LISTED or "'" in word or "’" in word or "‘" in word:
        return _listed_kinds(word)
    if len(word) < 4:
        return OTHERS
    return _ENDS_LY if word.endswith("ly") else _ENDS_ED if word.endswith("ed") else OTHERS


def _listed_kinds(word: str) -> int:
    plain = word.translate(CURLY)

    def adverb(w: str) -> bool:
        return len(w) >= 4 and w.endswith("ly") and w not in _NOT_ADVERBS

    regular = len(plain) >= 4 and plain.endswith("ed") and plain not in _NOT_PARTICIPLES and plain not in _NOT_ADVERBS
    tests = (
        (Kind.WEASEL, word in _WEASELS), (Kind.HEDGE, word in _HEDGES), (Kind.LY, adverb(word)), (Kind.AUXILIARY, plain in _AUXILIARIES), (Kind.MODAL, word in _MODALS),
        (Kind.PARTICIPLE, plain in _IRREGULAR or regular), (Kind.ADJECTIVE, plain in _ADJECTIVES), (Kind.BETWEEN, plain in _BETWEEN or adverb(plain)),
        (Kind.BY, plain == "by"), (Kind.AGENT, plain not in _NOT_AGENTS), (Kind.STOP, word in _STOPS or base_form(word) in _STOPS),
    )
    return sum(int(kind) for kind, holds in tests if holds)


def syllables(word: str) -> int:
    """Vowel groups without silent endings, at least one; none without letters a to z."""
    plain = word if word.isascii() and word.isalpha() and word.islower() else OTHER.sub("", word)
    if len(plain) <= 3:
        return int(bool(plain))
    silent = 0
    if plain[-1] == "e":
        silent = 2 * (plain[-2] not in "laeiouy")
    elif plain[-2] == "e" and plain[-1] in "sd":
        silent = 3 * (plain[-3] not in ("laeiouy" if plain[-1] == "s" else "taeiouyd"))
    spoken = plain[: len(plain) - silent].removeprefix("y")
    return max(1, len(spoken.translate(GROUPS).split()))


class Memo(dict):
    """What a function gives for each distinct argument; forgotten when there are very many."""

    MOST = 200_000

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        if len(self) >= self.MOST:
            self.clear()
        value = self[key] = self.function(key)
        return value
