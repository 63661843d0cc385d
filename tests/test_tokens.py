"""Words of many texts at once: the same as one text after another, and rules read few of them."""

import random
import re

import pyarrow as pa

from prosemill.operators import scan as S
from prosemill.operators import words as W
from prosemill.operators.tokens import Tokens

PIECES = ["Net", "net", "É", "ÿ", "ß", "Þ", "×", "÷", "’", "'", "-", "Ж", "中", "İ", " ", "\n", ". ", "　", "x’y", "was torn", "only", "", "1"]


def test_words_of_many_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    for batch in (texts, ["", "plain words only", ""], ["", ""], []):
        found = Tokens(batch)
        gaps, kinds = found.gaps(W.Memo(S.gap_bits)).tolist(), found.kinds(W.Memo(W.kinds)).tolist()
        written, lower, at = found.written().to_pylist(), found.lower().to_pylist(), 0
        for d, text in enumerate(batch):
            end = 0
            for m in re.finditer(S.WORD, text):
                assert (written[at], lower[at], found.doc[at]) == (m[0], m[0].lower(), d), text
                assert (found.low[at] - found.base[d], found.high[at] - found.base[d]) == m.span(), text
                assert (gaps[at], kinds[at]) == (S.gap_bits(text[end : m.start()]), W.kinds(m[0].lower())), text
                assert found.capital[at] == (m[0][0] != m[0][0].lower())
                at, end = at + 1, m.end()
        assert at == len(found) == found.offsets[-1]


def test_rules_read_few_words():
    texts = ["The boat lay by the pier. " * 400, "Nets were torn by rocks, and boats sank slowly slowly today.", "", None]
    scanner = S.Scanner(("near_lower", "near_gap", "words"), markdown=False, unicode=False)
    (found,) = scanner.scan([pa.record_batch([pa.array(range(4)), pa.array(texts, pa.string())], ["doc_id", "text"])])
    near = found.column("near_lower").to_pylist()
    assert near == [[], ["nets", "were", "torn", "by", "rocks", "and", "boats", "slowly", "slowly"], [], []]
    gaps = found.column("near_gap").to_pylist()[1]
    assert gaps[7] == S.FIRST and gaps[8] & (S.FIRST | S.PLAIN) == S.PLAIN


def test_phrases_are_looked_for_before_their_second_word():
    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    trie = S.Trie([S.Phrase("at the end", "cliche", "info", False), S.Phrase("it’s key", "deslop", "info", True), S.Phrase("delve", "deslop", "info", True)])
    trie.roots = tuple(Counting(root) for root in trie.roots)
    tokens = Tokens(["at sea " * 50, "At the end, it’s key. We delve at", "the end; at the. End"])
    found = trie.matches(tokens, tokens.gaps(W.Memo(S.gap_bits)))
    assert [(tokens.distinct[tokens.codes[a]], b - a, p.text) for a, b, p in found] == [("at", 2, "at the end"), ("it’s", 1, "it’s key"), ("delve", 0, "delve")]
    assert Counting.asked <= 5
