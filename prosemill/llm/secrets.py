"""Secret scans by assignment-aware lexing of source and configuration syntax."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._shared import slices, table

# The base patterns; letters of the names in either case.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"(?ai:{NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: Words of a name that make its value sensitive, and how much; words that say the value is something else.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "pass": 2.0, "secret": 3.0, "token": 3.0, "apikey": 3.0, "credential": 3.0,
    "credentials": 3.0, "auth": 2.0, "bearer": 2.0, "private": 1.0, "access": 1.0, "api": 1.0, "key": 1.5, "signature": 1.5,
} | dict.fromkeys("url uri path file name id count type length size field header param label expires ttl version format".split(), -3.0)
THRESHOLD = 4.5
MIN_CHARS = 8
MIN_DIGITS = 12
SATURATED = 1 << 40
STRINGS = {q: re.compile(rf"{q}(?:[^{q}\\\n]++|\\.)*+{q}") for q in "\"'"} | {"`": re.compile(r"`[^`\n]*+`")}
KEY = re.compile(r"[\"'][A-Za-z0-9_.$ -]++[\"'](?=\s*+(?::|=))")
LEX = re.compile(
    r"""(?P<prefix>(?<![A-Za-z0-9_])(?:[rbfuRBFU]|[rR][bfBF]|[bfBF][rR])(?=["']))|(?P<quote>["'`])"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+)|(?P<op>::?=|\?=|\+=|=>|==|!=|<=|>=|[=:+])|(?P<end>[\n;,{}()\[\]])|(?P<other>[^\s"'`;,{}()\[\]]++)"""
)
#: The brackets of a type, one level deep in others, in one line.
BRACKETS = re.compile(r"\[[^\[\]\n]*+(?:\[[^\[\]\n]*+\][^\[\]\n]*+)*+\]")
INDENT = re.compile(r"[ \t]*+")
BARE = re.compile(r"[^\s\"'`;,{}()\[\]]++")
PLACEHOLDER = re.compile(r"(?:[xX*.<>_-]+|\$\{?\w+\}?|%\w+%|<\w+>|\{\{?[\w. ]+\}?\})")
#: Elements and tags of markup: a named element with text, attributes, and the attributes that name and hold a setting.
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>\s*+([^<>\s][^<>\n]*+)</\1>")
TAG = re.compile(r"<[A-Za-z][^<>]*+>")
ATTRIBUTE = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)\s*+=\s*+(?:\"([^\"<>]*+)\"|'([^'<>]*+)')")
NAMING, HOLDING = frozenset(("key", "name", "id", "property")), frozenset(("value", "content"))
ASSIGNS = frozenset(("=", ":", ":=", "=>", "::=", "?=", "+="))
PLAIN_WORD = re.compile(r"[A-Za-z]?[a-z_./-]*")


def name_score(name: str) -> float:
    """Sensitivity of a name: the sum of its words' weights, camel case and separators split."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    parts = [p for p in re.split(r"[^a-z]+", words) if p]
    return sum(SENSITIVE.get(p, 0.0) for p in set(parts) | {"".join(parts)})


class Value:
    """What a name holds, by reference: a literal's span or two other values, and sums that tell whether it is a secret.

    Values are never copied, so a constant that is doubled a thousand times costs a thousand small objects.
    """

    __slots__ = ("size", "counts", "plain", "placeholder", "parts")

    @classmethod
    def literal(cls, text: str, span: tuple[int, int]) -> Value:
        self = cls()
        self.size, self.parts = len(text), span
        self.counts = Counter(c if c < "\x80" else "\x80" for c in text)
        if any(c.isspace() for c in text):
            self.counts[" "] += 1
        self.plain, self.placeholder = bool(PLAIN_WORD.fullmatch(text)), bool(PLACEHOLDER.fullmatch(text))
        if "://" in text and "@" not in text:
            self.placeholder = True
        return self

    def __add__(self, other: Value) -> Value:
        both = Value()
        both.size, both.parts = self.size + other.size, (self, other)
        both.counts = self.counts + other.counts
        if both.size > SATURATED:
            both.counts = Counter({c: n >> 20 for c, n in both.counts.items() if n >> 20 or c == " "})
            both.size = sum(both.counts.values())
        both.plain, both.placeholder = self.plain and other.plain, self.placeholder and other.placeholder
        return both

    def score(self) -> float:
        """How much the value looks like a secret: entropy, length, digits; no spaces, placeholders or plain words."""
        digits = sum(self.counts[d] for d in "0123456789")
        if self.size < MIN_CHARS or " " in self.counts or self.placeholder or (digits == self.size and digits < MIN_DIGITS):
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        return max(0.0, entropy * 0.6 + (0.5 if self.size >= 16 else 0.0) + (0.5 if digits else 0.0) - (1.5 if self.plain else 0.0))

    def spans(self, seen: set[int]) -> list[tuple[int, int]]:
        """Spans of the literals that make it up, but for values that ``seen`` has already; adds the new ones."""
        out, todo = [], [self]
        while todo:
            value = todo.pop()
            if id(value) not in seen:
                seen.add(id(value))
                if isinstance(value.parts[0], Value):
                    todo += value.parts
                else:
                    out.append(value.parts)
        return out


def markup_pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value) of elements that hold a text, and of tags in which one attribute names a setting and another holds it."""
    found = []
    if "</" in text:
        for m in ELEMENT.finditer(text):
            held = m[2].rstrip()
            found.append((m[1], Value.literal(held, (m.start(2), m.start(2) + len(held)))))
    if "<" in text:
        for tag in TAG.finditer(text):
            own = {m[1].lower(): m for m in ATTRIBUTE.finditer(text, *tag.span())}
            names, values = (sorted(own.keys() & kind) for kind in (NAMING, HOLDING))
            if names and values:
                name, value = own[names[0]], own[values[0]]
                group = 2 if value[2] is not None else 3
                if value[group]:
                    found.append((name[2] if name[2] is not None else name[3], Value.literal(value[group], value.span(group))))
    return found


def pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value) of every assignment, constants and concatenations propagated.

    ``name = a + b`` takes strings and names assigned before, as do strings side by side, strings in parentheses and ``name += a``; a type between
    the name and its ``=`` is passed over, and ``#define name a`` assigns; a bare word right of ``=`` or ``:`` counts as a literal unless it
    names a constant; a string that is a call's first argument goes with the called name. A name inside another one's braces, or in
    lines below it that are further in, is told with that name before it. A quote right after a letter or digit is an apostrophe or
    inch mark. A single quote opens a string after an operator, bracket or comma, else only a name with an operator behind it. A quote
    that is not closed in its line opens nothing; three quotes close at the next three.
    """
    known: dict[str, Value] = {}
    found: list[tuple[str, Value]] = []
    target: str | None = None
    value: Value | None = None
    more = False
    last: str | None = None
    call: str | None = None
    before = "\n"  # the token before: its kind, or an end's character
    annotated: str | None = None  # the name whose ":" may be followed by a type and "="
    assigned = ""  # the operator of the target
    define = False
    grouped = 0  # parentheses open around the target's value
    inside: list[str | None] = []  # names whose braces are open
    above: list[tuple[int, str]] = []  # names alone on their lines, with their indents
    indent = 0

    def close():
        nonlocal target, value, more, grouped
        if target is not None and value is not None:
            known[target] = value
            parent = inside[-1] if inside else None
            if parent is None and above and above[-1][0] < indent:
                parent = above[-1][1]
            found.append((target if parent is None else f"{parent}.{target}", value))
        target, value, more, grouped = None, None, False, 0

    upto = 0
    # Up to where a quote is known to be unclosed: each line is searched once for each kind; and the same of three quotes.
    unclosed = dict.fromkeys(STRINGS, 0)
    unclosed_three = dict.fromkeys(STRINGS, 0)
    while m := LEX.search(text, upto):
        kind, word, upto = m.lastgroup, m.group(), m.end()
        edge = 1
        if kind == "prefix":
            before = "prefix"
            continue
        if kind == "quote":
            at = m.start()
            joined = at > 0 and before != "prefix" and (text[at - 1].isalnum() or text[at - 1] == "_")
            if not joined and word != "`" and at >= unclosed_three[word] and text.startswith(3 * word, at):
                end = text.find(3 * word, at + 3)
                if end < 0:
                    unclosed_three[word] = len(text)
                else:
                    kind, word, upto, edge = "string", text[at : end + 3], end + 3, 3
            if kind == "quote":
                string = STRINGS[word].match(text, at) if at >= unclosed[word] and not joined else None
                if string is None and at >= unclosed[word] and not joined:
                    line = text.find("\n", at)
                    unclosed[word] = line if line >= 0 else len(text)
                if string is not None and word == "'" and before not in ("op", "prefix", "(", "[", "{", ",") and not (before == "string" and target is not None) and not KEY.match(text, at):
                    string = None
                if string is None:
                    continue
                kind, word, upto = "string", string.group(), string.end()
        if kind == "op":
            if word == "=" and annotated is not None and annotated == target and (value is None or before in ("name", "]", "other")):
                value, more, last = None, True, None
            elif word in ASSIGNS and last is not None and not more:
                close()
                target, more, last, assigned = last, True, None, word
                value = known.get(target) if word == "+=" else None
                annotated = target if word == ":" else None
            elif word == "+" and target is not None and value is not None:
                more = True
            else:
                close()
                last = None
            call = None
        elif kind == "end":
            if grouped and word in "()\n":
                grouped += (word == "(") - (word == ")")
            elif word == "(" and target is not None and more and value is None:
                grouped = 1
            elif word == "[" and annotated is not None and target == annotated and value is not None and (skipped := BRACKETS.match(text, upto - 1)):
                upto, word = skipped.end(), "]"
            else:
                call = last if word == "(" and not more else None
                kept = last if word == "]" else None
                if word in "{[":
                    inside.append(target if value is None and more else None)
                elif word in "}]" and inside:
                    close()
                    inside.pop()
                elif word == "\n":
                    if target is not None and value is None and assigned == ":" and not inside:
                        while above and above[-1][0] >= indent:
                            above.pop()
                        above.append((indent, target))
                close()
                last, annotated, define = kept, None, False
            if word == "\n":
                stop = INDENT.match(text, upto).end()
                if stop < len(text) and text[stop] != "\n" and not inside:
                    indent = stop - upto
                    while above and above[-1][0] >= indent:
                        above.pop()
        else:
            at = m.start()
            if kind == "string":
                word, at = word[edge:-edge], at + edge
            if define and kind == "name":
                close()
                target, more, assigned, last, define = word, True, "=", None, False
                before = kind
                continue
            if kind == "other" and word == "#define":
                define = True
            if target is not None and more:
                if kind != "string" and word not in known:
                    word = BARE.match(text, at)[0]
                    upto = at + len(word)
                if kind == "name" and word in known:
                    value = known[word] if value is None else value + known[word]
                elif word:
                    one = Value.literal(word, (at, at + len(word)))
                    value = one if value is None else value + one
                more = False
            elif kind == "string" and (grouped or before == "string") and target is not None and value is not None and word:
                value = value + Value.literal(word, (at, at + len(word)))
            elif grouped:
                pass
            elif kind == "other" and annotated is not None and annotated == target:
                pass
            else:
                close()
                if kind == "string" and call is not None and word:
                    found.append((call, Value.literal(word, (at, at + len(word)))))
            last = word if kind in ("name", "string") else None
            call = None
        before = word if kind == "end" else kind
    close()
    return found


def scan(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of secrets by kind in one text; base kinds first, then literals found by lexing."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "=" in text or ":" in text:
        spans["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    if "=" in text or ":" in text or "(" in text or "<" in text or "#define" in text:
        seen: set[int] = set()
        scores: dict[str, float] = {}
        held = pairs(text) + markup_pairs(text)  # keeps the values alive, so that their ids stay their own
        for name, value in held:
            if name not in scores:
                scores[name] = name_score(name)
            if scores[name] >= 2.0 and scores[name] + value.score() >= THRESHOLD and value.score() > 0:
                spans["literal"] += value.spans(seen)
        spans["literal"] = sorted(set(spans["literal"]))
    if "AKIA" in text:
        spans["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    spans["hex"] = [m.span() for m in HEX.finditer(text)]
    return spans


def shown(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end of each span by start, then kind, then end, comma-joined; code points, end exclusive."""
    rows = sorted((a, KINDS.index(k), b) for k in kinds for a, b in spans[k])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of secrets in every whole text.

    Null texts count as empty. Rows that repeat an id each get a row; other columns are ignored; an empty table
    gives no rows. Texts of any length are lexed in one pass.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def batches(it):
        for batch in slices(it, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scan(text or "")
                base = hashlib.sha256(shown(spans, KINDS[:3]).encode()).hexdigest()
                rows.append((*(len(spans[k]) for k in KINDS[:3]), base, shown(spans, KINDS)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
