"""Blocks and sentences of many texts at once: their code points are classed as one array, and each sign that may end a sentence is judged there."""

from __future__ import annotations

import re

import numpy as np

from prosemill.operators.mask import STRIP, WS
from prosemill.operators.segment import point_classes, sentence_ends

# Lines that always stand alone, the code points that they begin with, and where a plain sentence ends.
STANDALONE = re.compile(rf"[{WS}]{{0,6}}(?:[-*+][{WS}]|[0-9]{{1,9}}[.)][{WS}]|>|#{{1,6}}[{WS}]|\||\[[ xX]\][{WS}])")
PLAIN_END = re.compile(rf"(?<=[.!?])(?=[{WS}])")
_BLANK, _SIGN = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
_BLANK[[*map(ord, STRIP)]] = True
_SIGN[[*map(ord, STRIP + "-*+0123456789>#|[")]] = True
_A, _C, _I, _L, _N, _P, _S, _T, _U = b"ACILNPSTU"
_GOES_ON, _TELLS, _LETTERED = (np.isin(np.arange(256), list(letters)) for letters in (b"KAT", b"OULPAT", b"UL"))


def block_spans(text: str, masked: str) -> list[tuple[int, int]]:
    """Runs of lines joined by soft wraps; standalone lines are blocks of their own.

    A block starts at a line that is not blank and stands alone or follows a blank or standalone line; blank is judged on
    the masked text, standing alone on the original.
    """
    if "\n" not in masked:
        return [(0, len(masked))] if masked.strip(STRIP) else []
    spans: list[list[int]] = []
    at, joins = 0, False
    for raw, line in zip(text.split("\n"), masked.split("\n")):
        end = at + len(line)
        if line.strip(STRIP):
            alone = STANDALONE.match(raw) is not None
            if joins and not alone:
                spans[-1][1] = end
            else:
                spans.append([at, end])
            joins = not alone
        else:
            joins = False
        at = end + 1
    return [(a, b) for a, b in spans]


def sentence_spans(masked: str, blocks: list[tuple[int, int]], unicode: bool) -> tuple[list[int], list[int]]:
    """Sentences of the masked text without white space at their ends; blank ones are left out."""
    froms, tos = [], []
    for low, high in blocks:
        chunk = masked[low:high].replace("\n", " ")
        ends = sentence_ends(chunk) if unicode else [*(m.start() for m in PLAIN_END.finditer(chunk)), len(chunk)]
        start = 0
        for end in ends:
            piece = chunk[start:end]
            left = piece.lstrip(STRIP)
            if left:
                froms.append(low + end - len(left))
                tos.append(low + start + len(piece.rstrip(STRIP)))
            start = end
    return froms, tos


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


#: How many places are looked at one after another before all places are listed.
NEAR = 8


def _first(held: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on that is held, or ``limit`` if there is none before it."""
    at, top = at.copy(), len(held) - 1
    for _ in range(NEAR):
        going = np.flatnonzero(~held[np.minimum(at, top)] & (at < limit))
        if not len(going):
            return at
        at[going] += 1
    places = np.append(np.flatnonzero(held), len(held))
    at[going] = np.minimum(places[np.searchsorted(places, at[going])], limit[going])
    return at


def _last(held: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The place after the last held one before ``at``, or ``least`` if there is none after it."""
    top = len(held)
    return top - _first(held[::-1], top - at, top - least)


def _blocks(texts: list[str], masks: list[str], points: np.ndarray, feeds: np.ndarray, solid: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``block_spans`` of all texts laid end to end with line feeds between them."""
    starts, ends = np.append(0, feeds + 1), np.append(feeds, len(points))
    filled = _first(solid, starts, ends) < ends
    raw = "\n".join(texts)
    first = points if texts is masks else _points(raw)
    signed = np.flatnonzero(filled)
    signed = signed[_SIGN[first[starts[signed]]]]
    alone = np.zeros(len(starts), bool)
    alone[signed] = [STANDALONE.match(raw, a, b) is not None for a, b in zip(starts[signed].tolist(), ends[signed].tolist())]
    wraps = filled & ~alone
    joined = np.append(False, wraps[1:] & wraps[:-1])
    joined[np.searchsorted(starts, base)] = False
    return starts[filled & ~joined], ends[filled & ~np.append(joined[1:], False)]


def _unicode_ends(classes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``sentence_ends`` within blocks that hold no ignored code points and no separators; ends of blocks are left out."""
    at = np.flatnonzero((classes == _T) | (classes == _A))
    block = np.searchsorted(low, at, "right") - 1
    own = block >= 0
    own[own] = at[own] < high[block[own]]
    at, block = at[own], block[own]
    limit, stop = high[block], classes[at] == _A
    end = _first(classes != _S, _first(classes != _C, at + 1, limit), limit)
    padded = np.append(classes, np.zeros(2, np.uint8))

    def class_at(i: np.ndarray) -> np.ndarray:
        return np.where(i < limit, padded[i], 0)

    ends = ~_GOES_ON[class_at(end)]
    after = class_at(at + 1)
    before = np.where(at > low[block], padded[at - 1], 0)
    inside = (after == _N) | ((after == _U) & _LETTERED[before])
    small = class_at(_first(_TELLS[classes], end, limit)) == _L
    return end[ends & ~(stop & (inside | small)) & (end < limit)]


def _plain_ends(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where ``PLAIN_END`` finds an end within blocks."""
    end = np.flatnonzero((points == 0x2E) | (points == 0x21) | (points == 0x3F)) + 1
    block = np.searchsorted(low, end, "right") - 1
    own = block >= 0
    own[own] = end[own] < high[block[own]]
    end = end[own]
    return end[_BLANK[points[end]]]


def sentences_of(texts: list[str], masks: list[str], unicode: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of each text: where its own begin among all, and their first and last places in their text.

    The same as ``sentence_spans`` of each. Only texts with ignored code points or separators other than line feeds are looked at one by one.
    """
    sizes = np.fromiter(map(len, masks), np.int64, len(masks))
    if not sizes.any():
        return np.zeros(len(masks) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    points = _points("\n".join(masks))
    feeds, solid = np.flatnonzero(points == 10), ~_BLANK[points]
    low, high = _blocks(texts, masks, points, feeds, solid, base)
    odd = np.zeros(0, np.int64)
    if unicode:
        classes = point_classes(points)
        classes[feeds] = _S
        odd = np.unique(np.searchsorted(base, np.flatnonzero((classes == _I) | (classes == _P)), "right") - 1)
        if len(odd):
            usual = ~np.isin(np.searchsorted(base, low, "right") - 1, odd)
            low, high = low[usual], high[usual]
        ends = _unicode_ends(classes, low, high)
    else:
        ends = _plain_ends(points, low, high)
    starts, stops = np.sort(np.append(low, ends)), np.sort(np.append(ends, high))
    froms, tos = _first(solid, starts, stops), _last(solid, stops, starts)
    kept = froms < stops
    froms, tos = froms[kept], tos[kept]
    doc = np.searchsorted(base, froms, "right") - 1
    froms, tos = froms - base[doc], tos - base[doc]
    if len(odd):
        found = [sentence_spans(masks[d], block_spans(texts[d], masks[d]), unicode) for d in odd.tolist()]
        doc = np.concatenate([doc, np.repeat(odd, [len(own) for own, _ in found])])
        order = np.argsort(doc, kind="stable")
        froms, tos = (np.concatenate([x, *(np.array(own[side], np.int64) for own in found)])[order] for side, x in ((0, froms), (1, tos)))
    return np.append(0, np.cumsum(np.bincount(doc, minlength=len(masks)))), froms, tos
