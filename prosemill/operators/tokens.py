"""The words of many texts at once: their bytes are classed as one array, and each distinct word and gap is judged once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prosemill.operators.words import LISTED, OTHERS

# Bytes of a letter by itself, and the distance from a capital to its small letter.
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_STEP = np.zeros(256, np.uint8)
_STEP[65:91] = 32
_APOSTROPHE = np.frombuffer("’".encode(), np.uint8)


class Tokens:
    """Words ``[A-Za-zÀ-ÖØ-öø-ÿ]+(['’-][...]+)*`` of ``texts``, in order; none lies in two texts.

    ``starts`` and ``ends`` are bytes in all texts laid end to end, ``low`` and ``high`` code points there, ``doc`` the text of each word,
    ``offsets`` the first word of each text and of none, ``base`` the first code point of each text.
    """

    def __init__(self, texts: list[str]):
        data = ("\n" + "\n".join(texts) + "\n").encode() if texts else b"\n"
        own = np.frombuffer(data, np.uint8)
        plain = data.isascii()
        letters = _ASCII[own]
        small = own + _STEP[own]
        if not plain:
            # Two bytes, of which the first is C3, are À to ÿ; × and ÷ are not letters.
            led = np.flatnonzero(own == 0xC3)
            second = own[led + 1]
            kept = (second != 0x97) & (second != 0xB7)
            letters[led[kept]] = letters[led[kept] + 1] = True
            small[led[kept & (second < 0x9F)] + 1] += 32
        inside = letters.copy()
        joins = np.flatnonzero((own == 0x27) | (own == 0x2D))
        inside[joins[letters[joins - 1] & letters[np.minimum(joins + 1, len(own) - 1)]]] = True
        if not plain:
            curly = np.flatnonzero(own == _APOSTROPHE[0])
            curly = curly[(own[curly + 1] == _APOSTROPHE[1]) & (own[curly + 2] == _APOSTROPHE[2])]
            curly = curly[letters[curly - 1] & letters[curly + 3]]
            for k in range(3):
                inside[curly + k] = True
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self._data, self._own, self._small = data, own, small
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.cumsum(sizes + 1) - sizes
        if plain:
            self.low, self.high, first_bytes = self.starts, self.ends, self.base
        else:
            points = np.cumsum((own & 0xC0) != 0x80)
            self.low, self.high = points[self.starts] - 1, points[self.ends] - 1
            first_bytes = np.searchsorted(points, self.base + 1)
        self.offsets = np.append(np.searchsorted(self.starts, first_bytes), len(self.starts))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self._first_bytes = first_bytes

    def __len__(self) -> int:
        return len(self.starts)

    def _parts(self, data: bytes) -> pa.Array:
        """Gap, word and what is in neither, for each word; a text's first gap begins with the text."""
        cuts = np.empty(3 * len(self) + 1, np.int32)
        cuts[1:-1:3], cuts[2:-1:3] = self.starts, self.ends
        cuts[3:-1:3] = self.ends[:-1]
        cuts[-1] = self.ends[-1]
        filled = np.diff(self.offsets) > 0
        cuts[3 * self.offsets[:-1][filled]] = self._first_bytes[filled]
        return pa.StringArray.from_buffers(3 * len(self), pa.py_buffer(cuts), pa.py_buffer(data))

    def _taken(self, data: bytes, place: int) -> pa.Array:
        return self._parts(data).take(pa.array(np.arange(place, 3 * len(self), 3))) if len(self) else pa.array([], pa.string())

    def written(self) -> pa.Array:
        """Words as they are written."""
        return self._taken(self._data, 1)

    @cached_property
    def _coded(self) -> tuple[np.ndarray, pa.Array]:
        found = self._taken(self._small.tobytes(), 1).dictionary_encode()
        return found.indices.to_numpy(), found.dictionary

    @property
    def codes(self) -> np.ndarray:
        """The place of each word, in lower case, among ``distinct``."""
        return self._coded[0]

    @cached_property
    def distinct(self) -> list[str]:
        words = self._coded[1]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n") if len(words) else []

    def among(self, listed: Iterable[str]) -> np.ndarray:
        """Whether each distinct word is one of these."""
        return np.array(pc.is_in(self._coded[1], value_set=pa.array(sorted(listed), pa.string())), bool)

    def beginning(self, letters: str) -> np.ndarray:
        """Whether each distinct word begins so."""
        return np.array(pc.starts_with(self._coded[1], letters), bool)

    @cached_property
    def curly(self) -> np.ndarray:
        """The distinct words with a typographic apostrophe."""
        return np.flatnonzero(np.array(pc.match_substring(self._coded[1], "’"), bool))

    def lower(self) -> pa.Array:
        return self._coded[1].take(pa.array(self.codes))

    def judged(self, memo: dict) -> np.ndarray:
        """The number that ``memo`` has for each word in lower case."""
        return np.fromiter(map(memo.__getitem__, self.distinct), np.int32, len(self.distinct))[self.codes]

    def kinds(self, memo: dict) -> np.ndarray:
        """The bits of each word: only words that a list holds or whose ending counts are looked at one by one."""
        words = self._coded[1]
        tests = (pc.is_in(words, value_set=pa.array(sorted(LISTED))), *(pc.ends_with(words, x) for x in ("ly", "ed")), *(pc.match_substring(words, x) for x in "'’"))
        told = np.flatnonzero(reduce(pc.or_, tests).to_numpy(zero_copy_only=False))
        bits = np.full(len(words), OTHERS, np.int32)
        bits[told] = np.fromiter((memo[self.distinct[k]] for k in told.tolist()), np.int32, len(told))
        return bits[self.codes]

    def gaps(self, memo: dict) -> np.ndarray:
        """The number that ``memo`` has for what lies between each word and the one before it, or the text's start."""
        found = self._taken(self._data, 0).dictionary_encode()
        return np.fromiter(map(memo.__getitem__, found.dictionary.to_pylist()), np.int32, len(found.dictionary))[found.indices.to_numpy()]

    @cached_property
    def capital(self) -> np.ndarray:
        """Whether a word's first letter is a capital."""
        at = self.starts + (self._own[self.starts] == 0xC3)
        return self._own[at] != self._small[at]
