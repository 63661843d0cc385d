import random
import time

import pytest

from prosemill.operators import measures as M
from prosemill.plans.engine import ProseEngine


def slow_runs(lengths, run, spread):
    found, start = [], 0
    while start < len(lengths):
        end = start
        while end + 1 < len(lengths) and max(lengths[start : end + 2]) - min(lengths[start : end + 2]) <= spread:
            end += 1
        if end - start + 1 >= run:
            found.append({"fromIndex": start, "toIndex": end, "length": end - start + 1})
            start = end + 1
        else:
            start += 1
    return found


def test_monotone_runs_against_slow_search():
    rng = random.Random(1)
    for _ in range(500):
        lengths = [rng.randrange(9) for _ in range(rng.randrange(25))]
        assert M.monotone_runs(lengths, 4, 3) == slow_runs(lengths, 4, 3)
    assert M.monotone_runs([20, 21, 22, 20]) == [{"fromIndex": 0, "toIndex": 3, "length": 4}]
    for lengths in ([7] * 50000, [1, 90] * 25000):
        began = time.time()
        M.monotone_runs(lengths)
        assert time.time() - began < 1


def test_rhythm(spark):
    sentences = spark.createDataFrame([(1, i, w) for i, w in enumerate([3, 9, 25, 40])] + [(2, i, w) for i, w in enumerate([20, 21, 22, 20])], "doc_id int, sent_idx int, words int")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    rows = {r["doc_id"]: r for r in M.rhythm(docs, sentences).collect()}
    assert rows[1]["bands"] == ["short", "medium", "long", "veryLong"] and rows[1]["monotoneRuns"] == []
    assert [tuple(x) for x in rows[2]["monotoneRuns"]] == [(0, 3, 4)] and rows[2]["variety"] == 0.8
    assert rows[3]["lengths"] == [] and rows[3]["variety"] == 0.0
    flat = {r["doc_id"]: (r["runs"], r["flatSentences"]) for r in M.flat_sentences(M.rhythm(docs, sentences)).collect()}
    assert flat == {1: (0, 0), 2: (1, 4), 3: (0, 0)}
    assert M.RhythmOptions.of(run=0.5, spread=-2, long_min=float("nan")) == M.RhythmOptions(run=2, spread=0)


ECHO = [
    ("The pipeline broke. The pipeline failed. Our pipeline is a pipeline.", {"pipeline": 4}),
    ("We met Anna. Then Anna left. Later Anna spoke. So Anna won.", {}),
    ("Green tea helps. Some green tea cools. More green tea warms.", {"green": 3}),
    ("Alpha beta one. Nothing here now. Zero words there. Quiet again today. Alpha beta two. Still calm rain. Plain text stays. Alpha beta three.", {}),
    ("", {}),
]


def test_echoes(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ECHO)], "doc_id long, text string")
    engine = ProseEngine(docs, segmenter="regex")
    got: dict[int, dict] = {}
    for r in engine.echoes().collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["count"]
        first = ECHO[r["doc_id"]][0].lower()
        assert all(first[o:].startswith(r["term"].split(" ")[0]) for o in r["offsets"]) and len(r["offsets"]) == r["count"]
    for i, (_, want) in enumerate(ECHO):
        if want:
            assert {k: got[i].get(k) for k in want} == want
        else:
            assert i not in got
    assert engine.echoes(M.EchoOptions.of(most=0)).count() == 0
    assert M.EchoOptions.of(min_count=2, window=0, min_length=1.5) == M.EchoOptions()


def test_delta(spark):
    columns = ["doc_id", *(k for k, _, _ in M.METRICS)]
    before = spark.createDataFrame([(1, 120.0, 11.4, 48.2, 24.0, 4.0, 3.0, 9.0, 2.0, 1.0, 5.0, 3.0)], columns)
    after = spark.createDataFrame([(1, 96.0, 8.9, 62.7, 17.0, 1.0, 3.0, 4.0, 0.0, 1.0, 0.0, 5.0)], columns)
    rows = {r["key"]: r for r in M.delta(before, after).collect()}
    assert [r["key"] for r in sorted(rows.values(), key=lambda r: r["ord"])] == columns[1:]
    assert (rows["words"]["delta"], rows["words"]["better"]) == (-24.0, None)
    assert (rows["grade"]["delta"], rows["grade"]["better"]) == (-2.5, True)
    assert (rows["flesch"]["delta"], rows["flesch"]["better"]) == (14.5, True)
    assert (rows["hedge"]["delta"], rows["hedge"]["better"]) == (0.0, None)
    assert (rows["longSentence"]["delta"], rows["longSentence"]["better"]) == (2.0, False)
    assert M.has_moved(M.delta(before, after)).first()["moved"] is True
    assert M.has_moved(M.delta(before, before)).first()["moved"] is False


def test_snapshot_fills_gaps(spark):
    stats = spark.createDataFrame([(1, 10, float("nan"), None, 3.0)], "doc_id int, words int, grade double, flesch double, avgSentenceWords double")
    counts = spark.createDataFrame([(1, "passive", 3), (1, "unknown", 9)], "doc_id int, rule string, n int")
    row = M.snapshot(stats, counts).first()
    assert (row["words"], row["grade"], row["flesch"], row["passive"], row["weasel"]) == (10.0, 0.0, 0.0, 3.0, 0.0)


@pytest.mark.parametrize(("text", "n"), [("A rich tapestry. We delve into it.", 2), ("Plain words only.", 0)])
def test_free_count_equals_resolved_count(spark, text, n):
    from prosemill.plans.options import RuleOptions

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    engine = ProseEngine(docs, RuleOptions(is_pro=True), segmenter="regex")
    assert engine.machine_prose_count().first()["n"] == n == engine.marks.where("rule = 'deslop'").count()
