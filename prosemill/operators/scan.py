"""One pass of Arrow batches over texts: what is prose, where sentences and words are, and which listed phrases begin where.

A document stays one row. All places are code points of the original text. Words are found in all texts of a piece of a batch
at once (``tokens``). Rules are Spark expressions over the arrays that come out; they read only the words that a rule can look at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prosemill.operators.mask import HOLE, STRIP, WS, solid_text
from prosemill.operators.sentences import sentences_of
from prosemill.operators.tokens import Tokens
from prosemill.operators.words import Kind, Memo, kinds, syllables

#: Bits of the gap before a word: no word before it in its sentence; only white space of the original text; that and at most
#: eight characters; at most eight blanks of the masked text.
FIRST, PLAIN, CLOSE, TIGHT = 1, 2, 4, 8
BATCH_BYTES = 1 << 20
# The word pattern, and reframing constructions.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(f"[{LETTERS}]+(?:['’-][{LETTERS}]+)*")
NEAR = re.compile(r"[ \t\n\r]{0,8}\Z")
_B, _E, _S = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])", f"[{WS}]"
_NOT_JUST = f"(?:{_B}(?:it|that|this)['’]s{_S}{{1,3}})?{_B}(?:isn['’]t|aren['’]t|not){_S}{{1,3}}just{_E}[^\\n.;]{{1,60}}?"
REFRAMES = tuple(
    re.compile(p, re.IGNORECASE | re.ASCII)
    for p in (
        f"{_B}not{_S}{{1,3}}only{_E}[^\\n.;]{{1,60}}?{_B}but{_S}{{1,3}}also{_E}",
        f"{_NOT_JUST}{_B}but{_E}",
        f"{_NOT_JUST}[,:—–.]{_S}{{0,4}}(?:it['’]s|it{_S}{{1,3}}is|they['’]re|that['’]s|this{_S}{{1,3}}is){_E}",
    )
)
NEGATIONS = ("not", "isn't", "isn’t", "aren't", "aren’t")
SUBJECTS = ("it's", "it’s", "that's", "that’s", "this's", "this’s")

_INTS, _STRINGS = pa.list_(pa.int32()), pa.list_(pa.string())
_PHRASE = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("rule", pa.string()), ("severity", pa.string()), ("word", pa.string()), ("folded", pa.bool_())])
_DASH = pa.struct([("at", pa.int32()), ("sent", pa.int32())])
_SPAN = pa.struct([("from", pa.int32()), ("to", pa.int32())])
_TERM = pa.struct(
    [("kind", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("offsets", _INTS), ("proper", pa.bool_()), ("doubles", pa.bool_())]
)
#: What a scan can give for each document. ``solid`` is the text with a mark for each masked character, ``words`` the words of
#: each sentence, ``kind`` the bits of each word, ``gap`` those of the gap before it. ``near_`` are those of the words that rules look at.
FIELDS = {
    "solid": pa.string(), "sent_from": _INTS, "sent_to": _INTS, "sent_text": _STRINGS, "words": _INTS, "syllables": _INTS, "spoken": _INTS, "sent_first": _INTS, "tok_from": _INTS,
    "tok_to": _INTS, "token": _STRINGS, "lower": _STRINGS, "kind": _INTS, "gap": _INTS,
    "near_from": _INTS, "near_to": _INTS, "near_lower": _STRINGS, "near_kind": _INTS, "near_gap": _INTS, "dashes": pa.list_(_DASH), "phrases": pa.list_(_PHRASE), "reframes": pa.list_(_SPAN), "terms": pa.list_(_TERM),
}


@dataclass(frozen=True)
class Phrase:
    """A listed phrase. ``folded``: apostrophes are plain and gaps are near in the masked text, else gaps are white space of the original."""

    text: str
    rule: str
    severity: str
    folded: bool


class Trie:
    """Phrases by their words: a node is a dict from the next word, with the phrase that ends there under the empty word.

    Plain and folded phrases are two tries, as they compare words and gaps in their own ways.
    """

    APOSTROPHES = str.maketrans("’‘‛", "'''")

    def __init__(self, phrases: Iterable[Phrase]):
        self.roots: tuple[dict, dict] = {}, {}
        for p in phrases:
            node = self.roots[p.folded]
            for word in p.text.split(" "):
                node = node.setdefault(word.translate(self.APOSTROPHES) if p.folded else word, {})
            node.setdefault("", p)

    def _among(self, listed: Iterable[str], tokens: Tokens, folded: int) -> np.ndarray:
        """Whether each distinct word is one of these."""
        found = tokens.among(listed)
        if folded:
            for k in tokens.curly.tolist():
                found[k] = tokens.distinct[k].translate(self.APOSTROPHES) in listed
        return found

    def matches(self, tokens: Tokens, gaps: np.ndarray) -> list[tuple[int, int, Phrase]]:
        """(first word, last word, phrase): from left to right the longest phrase at each place after the one before, for each trie.

        Only words that begin some phrase, and are one or precede the second word of one, are looked at; no phrase passes the end of a text.
        """
        found = []
        codes, distinct = tokens.codes, tokens.distinct
        for folded, root in enumerate(self.roots):
            if not root:
                continue
            words = distinct
            near = TIGHT if folded else CLOSE
            if folded and len(tokens.curly):
                words = list(distinct)
                for k in tokens.curly.tolist():
                    words[k] = distinct[k].translate(self.APOSTROPHES)
            begins = self._among(root, tokens, folded)
            single = self._among([w for w, node in root.items() if "" in node], tokens, folded)
            second = self._among([*chain.from_iterable(root.values())], tokens, folded)
            last = -1
            places = np.flatnonzero(begins[codes])
            after = np.minimum(places + 1, len(codes) - 1)
            places = places[single[codes[places]] | (second[codes[after]] & (gaps[after] & near != 0))]
            for i, limit in zip(places.tolist(), tokens.offsets[tokens.doc[places] + 1].tolist()):
                if i <= last:
                    continue
                node, j, best = root[words[codes[i]]], i, None
                while True:
                    if "" in node:
                        best = (i, j, node[""])
                    j += 1
                    if j >= limit or words[codes[j]] not in node or not gaps[j] & near:
                        break
                    node = node[words[codes[j]]]
                if best:
                    found.append(best)
                    last = best[1]
        return found


def gap_bits(gap: str) -> int:
    blank = not gap.strip(STRIP)
    return PLAIN * blank + CLOSE * (blank and len(gap) <= 8) + TIGHT * bool(NEAR.match(gap.replace(HOLE, " ")))


def reframe_spans(masked: str, begins: Iterable[int]) -> list[tuple[int, int]]:
    """Reframing constructions that begin at some of these places, overlaps removed from left to right, longest first."""
    longest: dict[int, int] = {}
    for pattern in REFRAMES:
        end = 0
        for a in sorted(begins):
            if a >= end and (m := pattern.match(masked, a)):
                end = m.end()
                longest[a] = max(end, longest.get(a, 0))
    kept, end = [], 0
    for a in sorted(longest):
        if a >= end:
            end = longest[a]
            kept.append((a, end))
    return kept


def reframed(tokens: Tokens, masks: list[str]) -> list[list[dict]]:
    """The reframing constructions of each text: they begin with a negation before "only" or "just", or with the word before that."""
    distinct, codes, doc = tokens.distinct, tokens.codes, tokens.doc
    only = tokens.beginning("only") | tokens.beginning("just")
    begins: dict[int, set[int]] = {}
    for i in np.flatnonzero(only[codes]).tolist():
        for k, ends in ((i - 1, NEGATIONS), (i - 2, SUBJECTS)):
            own = [end for end in ends if k >= 0 and doc[k] == doc[i] and distinct[codes[k]].endswith(end)]
            if not own:
                break
            begins.setdefault(int(doc[i]), set()).update(int(tokens.high[k] - tokens.base[doc[i]]) - len(end) for end in own)
    out: list[list[dict]] = [[] for _ in masks]
    for d, places in begins.items():
        out[d] = [{"from": a, "to": b} for a, b in reframe_spans(masks[d], places)]
    return out


def _places_of(keys: np.ndarray, places: np.ndarray, sents: np.ndarray, window: int, least: int) -> dict[int, list[int]]:
    """The places of each key that some ``window`` sentences hold ``least`` times.

    Places of a key are in order, so it qualifies if a place and the one ``least`` - 1 later are near.
    """
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    n = max(0, len(keys) - least + 1)
    later = slice(least - 1, least - 1 + n)
    near = (keys[:n] == keys[later]) & (sents[places[later]] - sents[places[:n]] < window)
    heard = np.unique(keys[:n][near])
    return {
        key: places[a:b].tolist() for key, a, b in zip(heard.tolist(), np.searchsorted(keys, heard, "left"), np.searchsorted(keys, heard, "right"))
    }


def repeated_terms(tokens: Tokens, stops: np.ndarray, sents: np.ndarray, window: int, least: int, shortest: int) -> list[list[dict]]:
    """For each text, words and pairs of words that some ``window`` sentences hold ``least`` times, with all their places.

    ``proper`` tells whether a word of the term is always capitalised inside sentences, ``doubles`` whether a pair has exactly
    the places of a repeated word. ``sents`` number the sentences of all texts.
    """
    out: list[list[dict]] = [[] for _ in tokens.base]
    n, codes, distinct = len(tokens), tokens.codes.astype(np.int64), tokens.distinct
    size = len(distinct)
    own = tokens.doc * size + codes
    single = np.flatnonzero(~stops & (tokens.high - tokens.low >= shortest))
    words = _places_of(own[single], single, sents, window, least)
    inner = np.flatnonzero((sents[1:] == sents[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])) + 1
    second = inner[~(stops[inner] & stops[inner - 1])]
    pairs = _places_of(own[second - 1] * size + codes[second], second - 1, sents, window, least)
    if not words and not pairs:
        return out
    parts = np.unique(np.array([*words, *(k // size for k in pairs), *(k // size // size * size + k % size for k in pairs)], np.int64))
    about = inner[np.isin(own[inner], parts)]
    capital = tokens.capital[about]
    proper = set(own[about[capital]].tolist()) - set(own[about[~capital]].tolist())
    low, base = tokens.low, tokens.base

    def add(kind: str, term: str, places: list[int], named: bool, doubles: bool) -> None:
        doc = tokens.doc[places[0]]
        out[doc].append({"kind": kind, "term": term, "count": len(places), "offsets": (low[places] - base[doc]).tolist(), "proper": named, "doubles": doubles})

    for key, places in words.items():
        add("word", distinct[key % size], places, key in proper, False)
    for key, places in pairs.items():
        a = key // size
        b = a // size * size + key % size
        doubles = words.get(a) == places or words.get(b) == [i + 1 for i in places]
        add("phrase", f"{distinct[a % size]} {distinct[b % size]}", places, a in proper or b in proper, doubles)
    return out


#: How far the passive looks from a form of be or get: one word before it and five after.
REACH = range(-1, 6)


def near_words(tokens: Tokens, kind: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that a rule can look at, and the bits of the gaps before them; one whose neighbour is left out counts as its sentence's first.

    These are words of a list or in -ly, words that repeat the one before, and those around an auxiliary that a participle or an adverb follows.
    """
    n = len(tokens)
    kept = kind & int(Kind.WEASEL | Kind.HEDGE | Kind.LY) != 0
    alike = (tokens.codes[1:] == tokens.codes[:-1]) & (gap[1:] & (PLAIN | FIRST) == PLAIN) & (tokens.doc[1:] == tokens.doc[:-1])
    kept[1:] |= alike
    kept[:-1] |= alike
    heads = np.flatnonzero((kind[:-1] & int(Kind.AUXILIARY) != 0) & (kind[1:] & int(Kind.PARTICIPLE | Kind.BETWEEN) != 0))
    for k in REACH:
        at = heads + k
        own = (at >= 0) & (at < n)
        at, head = at[own], heads[own]
        kept[at[tokens.doc[at] == tokens.doc[head]]] = True
    places = np.flatnonzero(kept)
    gaps = gap[places]
    gaps[1:][np.diff(places) > 1] = FIRST
    return places, gaps


@dataclass(frozen=True)
class Scanner:
    """How texts are scanned and which ``FIELDS`` are given. ``echo`` is (window, least count, least length) of repeated terms."""

    fields: tuple[str, ...]
    markdown: bool = True
    unicode: bool = True
    phrases: tuple[Phrase, ...] = ()
    echo: tuple[int, int, int] = (4, 3, 4)

    def scan(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memos = Trie(self.phrases), (Memo(kinds), Memo(gap_bits), Memo(syllables))
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            found = self._found(texts, trie, *memos)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[found[c] for c in self.fields]], ["doc_id", *self.fields])

    def _found(self, texts: list[str], trie: Trie, bits: Memo, gap_of: Memo, spoken_of: Memo) -> dict[str, pa.Array]:
        """The fields of some texts as columns. Places are first those in all texts laid end to end."""
        wanted = set(self.fields)
        needs_words = wanted - {"solid", "sent_from", "sent_to", "sent_text", "dashes"}
        needs_sentences = wanted - {"solid", "reframes", "token", "lower", "kind", "tok_from", "tok_to", "phrases", "near_from", "near_to", "near_lower", "near_kind"}
        found: dict[str, pa.Array] = {}
        solids = [solid_text(text) for text in texts] if self.markdown else texts
        masks = [solid.replace(HOLE, " ") for solid in solids]
        found["solid"] = solids

        def own(places: np.ndarray, d: int) -> list[int]:
            return places[of_sentences[d] : of_sentences[d + 1]].tolist()

        if needs_sentences:
            of_sentences, froms, tos = sentences_of(texts, masks, self.unicode)
            found |= {"sent_from": _listed(of_sentences, froms), "sent_to": _listed(of_sentences, tos)}
        if "sent_text" in wanted:
            found["sent_text"] = [[masked[a:b].replace("\n", " ") for a, b in zip(own(froms, d), own(tos, d))] for d, masked in enumerate(masks)]
        if "dashes" in wanted:
            found["dashes"] = [dash_places(masked, own(froms, d)) if "—" in masked else [] for d, masked in enumerate(masks)]
        if needs_words:
            tokens = Tokens(solids)
            of_words, base = tokens.offsets, tokens.base[tokens.doc]
            low, high = tokens.low - base, tokens.high - base
            found |= {"tok_from": _listed(of_words, low), "tok_to": _listed(of_words, high)}
            gap = tokens.gaps(gap_of)
            if needs_sentences:
                at = np.repeat(tokens.base, np.diff(of_sentences))
                first = np.searchsorted(tokens.low, froms + at)
                counts = np.searchsorted(tokens.low, tos + at) - first
                gap[first[counts > 0]] |= FIRST
                own_first = first - np.repeat(of_words[:-1], np.diff(of_sentences))
                found |= {"words": _listed(of_sentences, counts), "sent_first": _listed(of_sentences, own_first)}
            found["gap"] = _listed(of_words, gap)
            if "token" in wanted:
                found["token"] = _listed(of_words, tokens.written())
            if "lower" in wanted:
                found["lower"] = _listed(of_words, tokens.lower())
            if wanted & {"kind", "terms", "near_from", "near_to", "near_lower", "near_kind", "near_gap"}:
                kind = tokens.kinds(bits)
                found["kind"] = _listed(of_words, kind)
            if wanted & {"near_from", "near_to", "near_lower", "near_kind", "near_gap"}:
                places, gaps = near_words(tokens, kind, gap)
                of_near = np.searchsorted(places, of_words)
                near = {"from": low[places], "to": high[places], "kind": kind[places], "gap": gaps}
                found |= {f"near_{c}": _listed(of_near, x) for c, x in near.items()}
                found["near_lower"] = _listed(of_near, pa.array([tokens.distinct[c] for c in tokens.codes[places]], pa.string()))
            if wanted & {"syllables", "spoken"}:
                spoken = tokens.judged(spoken_of)
                found["spoken"] = _listed(of_words, spoken)
                if needs_sentences:
                    upto = np.concatenate(([0], np.cumsum(spoken)))
                    found["syllables"] = _listed(of_sentences, upto[first + counts] - upto[first])
            if "reframes" in wanted:
                found["reframes"] = reframed(tokens, masks)
            if "phrases" in wanted:
                hits = sorted(trie.matches(tokens, gap), key=lambda hit: tokens.doc[hit[0]])
                begin, end = (np.array([hit[k] for hit in hits], np.int64) for k in (0, 1))
                columns = [pa.array(low[begin], pa.int32()), pa.array(high[end], pa.int32())]
                columns += [pa.array([getattr(p, c) for _, _, p in hits], kind) for c, kind in (("rule", pa.string()), ("severity", pa.string()), ("text", pa.string()), ("folded", pa.bool_()))]
                found["phrases"] = _listed(np.searchsorted(tokens.doc[begin], np.arange(len(texts) + 1)), pa.StructArray.from_arrays(columns, fields=list(_PHRASE)))
            if "terms" in wanted:
                sents = np.repeat(np.arange(len(counts)), counts)
                found["terms"] = repeated_terms(tokens, kind & int(Kind.STOP) != 0, sents, *self.echo)
        return {c: found[c] if isinstance(found[c], pa.Array) else pa.array(found[c], FIELDS[c]) for c in self.fields}

    def schema(self, docs: DataFrame) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_type

        out = T.StructType([docs.schema["doc_id"]])
        for c in self.fields:
            out = out.add(c, from_arrow_type(FIELDS[c]))
        return out


def _listed(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Values laid end to end as one list for each text; numbers are of 32 bits."""
    items = values if isinstance(values, pa.Array) else pa.array(np.ascontiguousarray(values, np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)


def dash_places(masked: str, froms: list[int]) -> list[dict]:
    """Em dashes with the number of their sentence."""
    return [{"at": m.start(), "sent": bisect_right(froms, m.start()) - 1} for m in re.finditer("—", masked)]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about ``BATCH_BYTES`` of text, so that a task holds few at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        last = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES, append=-1))
        at = 0
        for end in (last + 1).tolist():
            yield batch.slice(at, end - at)
            at = end


def _run(scanner: Scanner, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return scanner.scan(_pieces(batches))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``doc_id`` and the scanner's fields for each document; a null text counts as empty. One Python evaluation."""
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(partial(_run, scanner), scanner.schema(docs))
