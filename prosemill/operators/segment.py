"""Sentence ends by the default rules of UAX #29, on a text's classes."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# The Sentence_Break classes that general categories do not give.
A_TERM = ".․﹒．"
S_TERM = "!?։؝؞؟۔܀܁܂।॥၊။።፧፨‼‽⁇⁈⁉⸮。﹖﹗！？｡"
S_CONTINUE = ",-:;;՝،؍߸᠂᠈–—、︐︑︓︔︱︲﹐﹑﹔﹕﹘﹣，－：；､"
SEPARATORS = "\n\r\x85  "


class _Classes(dict):
    """Sentence_Break class of each code point, one letter each; the empty string for ignored ones."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        kind = unicodedata.category(char)
        if char in SEPARATORS:
            value = "P"
        elif char in A_TERM:
            value = "A"
        elif char in S_TERM:
            value = "T"
        elif char in S_CONTINUE:
            value = "K"
        elif char.isspace():
            value = "S"
        elif kind in ("Mn", "Mc", "Me", "Cf"):
            value = "I"
        elif kind in ("Ll",) or char in "ªº":
            value = "L"
        elif kind in ("Lu", "Lt"):
            value = "U"
        elif kind in ("Lo", "Lm", "Nl"):
            value = "O"
        elif kind == "Nd":
            value = "N"
        elif kind in ("Ps", "Pe", "Pi", "Pf") or char in "\"'❛❜❝❞":
            value = "C"
        else:
            value = "X"
        self[point] = value
        return value


_CLASSES = _Classes()
_KNOWN = np.zeros(0x110000, np.uint8)


def point_classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point as the code of its letter; that of ignored ones is I."""
    found = _KNOWN[points]
    if not found.all():
        for point in np.unique(points[found == 0]).tolist():
            _KNOWN[point] = ord(_CLASSES[point] or "I")
        found = _KNOWN[points]
    return found


def _break(of: dict[str, str]) -> re.Pattern:
    """Where a sentence ends, over characters whose classes are ``of``; what the pattern finds is the end of the sentence.

    A separator always ends it. Terminators with what closes them and white space do, unless a sign that goes on follows; a full stop
    does not inside numbers and abbreviations, nor where a small letter comes before any other letter, separator or terminator.
    """
    a, t, p, c, s, low = (of[k] for k in "ATPCSL")
    closed = f"[{c}]*+[{s}]*+"
    goes_on = f"(?![{of['K']}{a}{t}])"
    inside = f"(?![{of['N']}])(?!(?<=[{of['U']}{low}][{a}])[{of['U']}])"
    later = f"(?![^{''.join(of[k] for k in 'OULPAT')}]*+[{low}])"
    return re.compile(f"[{p}]|[{t}]{closed}(?:[{p}]|{goes_on})|[{a}](?:{closed}[{p}]|{inside}{closed}{goes_on}{later})")


def _plain_patterns() -> tuple[re.Pattern, re.Pattern]:
    """``_break`` over code points that are common in European texts, and a search for any other one."""
    known = [chr(p) for span in ((0, 0x250), (0x2010, 0x205F), (0x20A0, 0x20C0)) for p in range(*span) if _CLASSES[p] != "I"]
    of = {k: "".join(map(re.escape, [c for c in known if _CLASSES[ord(c)] == k])) for k in "ATPCSLUOKNX"}
    return _break(of), re.compile(f"[^{''.join(map(re.escape, known))}]")


_PLAIN_BREAK, _UNCOMMON = _plain_patterns()
_BREAK = _break({k: k for k in "ATPCSLUOKNX"})


def sentence_ends(chunk: str) -> list[int]:
    """Ends of the sentences of a text by the default rules of UAX #29; the last is the text's length.

    A text of common code points is searched itself, any other one as its classes.
    """
    if not chunk:
        return []
    if chunk.isascii() or not _UNCOMMON.search(chunk):
        ends = [m.end() for m in _PLAIN_BREAK.finditer(chunk)]
    else:
        classes = chunk.translate(_CLASSES)
        places = None
        if "I" in classes[1:]:
            places = [i for i, c in enumerate(classes) if c != "I" or i == 0]
            classes = "".join(classes[i] for i in places)
        ends = [m.end() for m in _BREAK.finditer(classes)]
        if places:
            ends = [places[end] if end < len(places) else len(chunk) for end in ends]
    if not ends or ends[-1] < len(chunk):
        ends.append(len(chunk))
    return ends
