"""Masking of everything in a Markdown text that is not prose, offset by offset."""

from __future__ import annotations

import re
from bisect import bisect_left
from codecs import charmap_decode
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands in the solid form for a masked character that was not white space; other uses of it become SUBSTITUTE.
HOLE, SUBSTITUTE = "\ue000", "\ue001"

# White space, and the constructs that a pattern finds, with their length limits. Patterns begin with the signs that they
# need, and look back from there: so a search passes over all other characters at once.
WS = r"\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
STRIP = "\t\n\x0b\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
WHOLE = [
    re.compile(r"\$\$(?s:.){0,5000}?\$\$"),
    re.compile(rf"\$(?=[^{WS}0-9])[^\n]{{0,499}}?(?<![{WS}])\$"),
    re.compile(r"<!--(?s:.){0,5000}?-->"),
    re.compile(rf"</?[A-Za-z][A-Za-z0-9-]{{0,40}}([{WS}][^<>\n]{{0,500}})?/?>"),
    re.compile(r"!?\[\[[^\]\n]{0,300}\]\]"),
    re.compile(rf"[hHwW](?<!(?i:[A-Za-z0-9_])[hHwW])(?i:(?<=h)ttps?://|(?<=w)ww\.)[^{WS}<>()\[\]]{{1,2000}}"),
    re.compile(r"\[\^[^\]\n]{0,60}\]"),
    re.compile(rf"[{WS}]\^[A-Za-z0-9-]{{1,40}}[{WS}]*(?=[\n\r\u2028\u2029]|\Z)"),
]
TAG = re.compile(rf"#(?<![^{WS}(\[{{]#)[A-Za-zÀ-ɏ][A-Za-z0-9_À-ɏ/-]{{0,80}}")
LINK = re.compile(rf"(!?)\[([^\]\n]{{0,300}})\]\([^){WS}\n]{{0,500}}(?:[{WS}]+\"[^\"\n]{{0,200}}\")?\)")
EMPHASIS = re.compile(r"[*=~_](?:(?<=\*)\*{0,2}|(?<==)=|(?<=~)~|(?<=_)_{0,2})")
HEADING = re.compile(rf"#{{1,6}}[{WS}]")
RULE = re.compile(rf"(?:={{2,}}|-{{3,}}|\*{{3,}}|_{{3,}})[{WS}]*\Z")
INDENTED = re.compile(rf"(?:\t| {{4,}})[^{WS}]")
INDENTED_ITEM = re.compile(rf"[ \t]+(?:[-*+]|[0-9]{{1,9}}[.)])[{WS}]")
MARKER = re.compile(rf"[{WS}]{{0,6}}(?:>[{WS}]?|[-*+][{WS}]+|[0-9]{{1,9}}[.)][{WS}]+|\[[ xX]\][{WS}]+)+")
#: Lines that are not prose, or have a marker, begin with one of these; most lines do not.
SIGNED = re.compile(rf"\n(?=[{WS}#=*_|>0-9+\[-])[^\n]+")
CONTEXT = re.compile(r"[ \t]*((?:>[ \t]*)*)")
FENCE = re.compile(r"(?P<run>`{3,}|~{3,})")
TICKS = re.compile(r"``*")
BREAK = re.compile(r"\n(?=[ \t\r]*(?:\n|\Z))")
SOLID = re.compile(rf"[^{WS}]")
BLANK = re.compile("[" + WS.replace(r"\n", "") + "]")
#: What hides each of the first 256 code points.
HIDDEN = "".join("\n" if c == "\n" else " " if c in STRIP else HOLE for c in map(chr, range(256)))
WORDISH = re.compile(r"[A-Za-z0-9_]")
CODE_REACH = 1000

Span = tuple[int, int]


def _lines(text: str) -> list[Span]:
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    return list(zip([0, *(e + 1 for e in ends[:-1])], ends))


def _front_matter(text: str, lines: list[Span]) -> Iterator[Span]:
    trimmed = (text[a:b].strip(STRIP) for a, b in lines)
    if len(lines) > 1 and text.startswith("---") and next(trimmed) == "---":
        closing = (end for (_, end), line in zip(lines[1:], trimmed) if line in ("---", "..."))
        yield from ((0, end) for end in closing)


def _fences(text: str, lines: list[Span]) -> Iterator[Span]:
    """Lines of fenced code: a fence ends at a bare run as long, of the same mark and quote depth, or with its quote.

    Outside fences, and in one that is not quoted, only lines with a run of marks are looked at.
    """
    opener = None
    for a, b in lines:
        if (opener is None or opener[1] == 0) and text.find("```", a, b) < 0 and text.find("~~~", a, b) < 0:
            if opener:
                yield a, b
            continue
        line = text[a:b]
        context = CONTEXT.match(line)
        depth = context[1].count(">")
        fence = FENCE.match(line, context.end())
        if opener is None:
            if fence:
                opener = (fence["run"], depth)
                yield a, b
            continue
        run, opened = opener
        if depth < opened and line.strip(STRIP):
            opener = None
            continue
        yield a, b
        same = fence and fence["run"].startswith(run) and depth == opened
        if same and not line[fence.end() :].strip(STRIP):
            opener = None


def _line_kinds(text: str, hidden: list[Span]) -> Iterator[Span]:
    """Headings, rules, table rows and indented code whole; of list items and quotes only the marker."""
    starts = {a: b for a, b in hidden}
    upto = max((b for a, b in hidden if a == 0), default=-1)
    for m in SIGNED.finditer("\n" + text):
        a, b, line = m.start(), m.end() - 1, m[0][1:]
        if not line.strip(STRIP) or starts.get(a, -1) >= b or b <= upto:
            continue
        body = line[CONTEXT.match(line).end() :]
        code = INDENTED.match(line) and not INDENTED_ITEM.match(line)
        if HEADING.match(body) or RULE.match(body) or body.startswith("|") or code:
            yield a, b
        elif marker := MARKER.match(line):
            yield a, a + marker.end()


def _code_spans(text: str) -> Iterator[Span]:
    """A run of backticks closes at the next run as long, within reach and before a blank line."""
    runs = [m.span() for m in TICKS.finditer(text)]
    breaks = [m.start() for m in BREAK.finditer(text)]
    following: list[int | None] = [None] * len(runs)
    latest: dict[int, int] = {}
    for i in range(len(runs) - 1, -1, -1):
        size = runs[i][1] - runs[i][0]
        following[i] = latest.get(size)
        latest[size] = i
    i = 0
    while i < len(runs):
        a, b = runs[i]
        at = bisect_left(breaks, b)
        reach = min(a + CODE_REACH, breaks[at] if at < len(breaks) else len(text))
        j = following[i]
        if j is not None and runs[j][0] < reach:
            yield a, runs[j][1]
            i = j
        i += 1


#: What a text must hold for a pattern to find anything in it: tests that cost next to nothing.
_HOLDS: list[tuple[re.Pattern, tuple[str, ...]]] = list(zip(WHOLE, (("$$",), ("$",), ("<!--",), ("<",), ("[[",), ("://", "www."), ("[^",), ("^",))))


def masked_spans(text: str) -> list[Span]:
    """What is not prose. Every construct is found in the original text; the spans may overlap."""
    fenced = "```" in text or "~~~" in text
    lines = _lines(text) if fenced or text.startswith("---") else []
    spans = [*_front_matter(text, lines)][:1]
    if fenced:
        spans += _fences(text, lines)
    spans += list(_line_kinds(text, spans))
    if "`" in text:
        spans += _code_spans(text)
    www = ("w." in text or "W." in text) and "www." in text.lower()
    for pattern, signs in _HOLDS:
        if any(www if sign == "www." else sign in text for sign in signs):
            spans += (m.span() for m in pattern.finditer(text))
    if "#" in text:
        spans += (m.span() for m in TAG.finditer(text))
    if "](" in text:
        for m in LINK.finditer(text):
            spans += [m.span()] if m[1] else [(m.start(), m.start(2)), (m.end(2), m.end())]
    if any(sign in text for sign in ("*", "==", "~~", "_")):
        for m in EMPHASIS.finditer(text):
            sides = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not (m[0].startswith("_") and all(map(WORDISH.match, sides))):
                spans.append(m.span())
    return spans


def hidden(part: str) -> str:
    """A masked part: HOLE for each character but white space, which becomes spaces and line feeds."""
    try:
        return charmap_decode(part.encode("latin-1"), "strict", HIDDEN)[0]
    except UnicodeEncodeError:
        return BLANK.sub(" ", SOLID.sub(HOLE, part))


def solid_text(text: str | None) -> str:
    """The text with masked white space as spaces and other masked characters as HOLE; line feeds stay."""
    if not text:
        return ""
    text = text.replace(HOLE, SUBSTITUTE)
    out, at = [], 0
    for a, b in sorted(masked_spans(text)):
        a = max(a, at)
        if a < b:
            out += [text[at:a], hidden(text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def masked(solid_column: Column) -> Column:
    """The masked text of a solid one: as long as the original, everything that is not prose a space."""
    return F.translate(solid_column, HOLE, " ")
