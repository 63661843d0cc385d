"""Sweeps and composed edits against plain searches."""

import random
import time

import pytest

from prosemill.operators import navigate as N

MARK = "doc_id long, `from` int, `to` int, rule string, message string"


def test_steps_equal_plain_search(spark):
    rng = random.Random(3)
    marks = {(d, f := rng.randrange(40), f + rng.randrange(1, 9), rng.choice("ab"), "m") for d in range(30) for _ in range(rng.randrange(9))}
    cursors = {(d, rng.randrange(-2, 45)) for d in range(31) for _ in range(12)}
    frame, asked = spark.createDataFrame(list(marks), MARK), spark.createDataFrame(list(cursors), "doc_id long, cursor int")
    for forward in (True, False):
        got = {(r["doc_id"], r["cursor"]): (r["from"], r["to"], r["rule"]) for r in N.step_mark(frame, asked, forward).collect()}
        want = {}
        for d, c in cursors:
            own = sorted((f, t, r) for e, f, t, r, _ in marks if e == d)
            beyond = [x for x in own if (x[0] > c if forward else x[0] < c)]
            if own:
                want[d, c] = (beyond or own)[0 if forward else -1]
        assert got == want


def test_sentences_equal_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for d in range(20):
        at = rng.randrange(3)
        for i in range(rng.randrange(8)):
            end = at + rng.randrange(1, 7)
            rows.append((d, i, at, end))
            at = end + rng.randrange(2)
    cursors = [(d, c) for d in range(21) for c in range(0, 50, 1)]
    sentences = spark.createDataFrame(rows, "doc_id long, sent_idx int, `from` int, `to` int")
    got = {(r["doc_id"], r["cursor"]): r["sent_idx"] for r in N.sentence_at(sentences, spark.createDataFrame(cursors, "doc_id long, cursor int")).collect()}
    assert got == {(d, c): min(held) for d, c in cursors if (held := [i for e, i, f, t in rows if e == d and f <= c <= t])}


def test_one_huge_document(spark):
    marks = spark.range(100_000).selectExpr("1L doc_id", "int(id * 3) `from`", "int(id * 3 + 2) `to`", "'adverb' rule", "'' message")
    cursors = spark.range(100_000).selectExpr("1L doc_id", "int(id * 3 + 1) cursor")
    began = time.time()
    assert N.step_mark(marks, cursors).selectExpr("count(*)", "sum(`from` - cursor)").first()[:] == (100_000, 2 * 99_999 - 299_998)
    assert time.time() - began < 30


def fold(offset, edits, side):
    for low, high, n in edits:
        if offset < low or (offset == low and (high > low or side < 0)):
            continue
        offset = (low if side < 0 else low + n) if offset < high else offset + n - (high - low)
    return offset


def log(rng, size, width):
    return [(a := rng.randrange(width), a + rng.choice([0, 0, 1, rng.randrange(12)]), rng.randrange(6)) for _ in range(size)]


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_composition_is_associative_and_right(size):
    rng = random.Random(size)
    for _ in range(60 if size < 100 else 3):
        edits = log(rng, size, 60)
        for side in (-1, 1):
            maps = [N._edit(*e, side) for e in edits]
            left = right = None
            for m in maps:
                left = m if left is None else N.compose(left, m)
            for m in reversed(maps):
                right = m if right is None else N.compose(m, right)
            for x in range(90):
                for starts, values, moves in (left, right):
                    i = max(k for k, s in enumerate(starts) if s <= x)
                    assert values[i] + (x - starts[i] if moves[i] else 0) == fold(x, edits, side)


def test_long_logs(spark):
    """A log of 100,000 edits and short ones, through the tree and the sweep, equal to the fold of each offset."""
    rng = random.Random(9)
    logs = {1: log(rng, 100_000, 5000), 2: log(rng, 3, 50), 3: log(rng, 700, 300)}
    edits = spark.createDataFrame([(d, i, *e) for d, es in logs.items() for i, e in enumerate(es)], "doc_id long, seq long, `from` long, `to` long, insert long")
    offsets = [(d, x) for d in (1, 2, 3, 4) for x in range(0, 6000, 997)]
    maps = N.composed(edits).persist()
    for side in (-1, 1):
        got = {(r["doc_id"], r["offset"]): r["moved"] for r in N.remap(maps, spark.createDataFrame(offsets, "doc_id long, offset long"), side).collect()}
        assert got == {(d, x): fold(x, logs.get(d, []), side) for d, x in offsets}
    maps.unpersist()


def test_step_mark_reads_the_marks_once(spark):
    marks = spark.createDataFrame([(1, 5, 9, "adverb", "m"), (1, 20, 24, "hedge", "m"), (None, 3, 4, "hedge", "m")], "doc_id long, `from` int, `to` int, rule string, message string")
    cursors = spark.createDataFrame([(1, 0), (1, 5), (1, 20), (1, 30), (2, 7), (None, 1)], "doc_id long, cursor int")
    for forward, expected in ((True, {0: 5, 5: 20, 20: 5, 30: 5}), (False, {0: 20, 5: 20, 20: 5, 30: 20})):
        found = N.step_mark(marks, cursors, forward)
        assert {r["cursor"]: r["from"] for r in found.collect()} == expected
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
