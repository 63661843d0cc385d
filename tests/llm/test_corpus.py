"""Mixing, chat, language ID, neighbours and the pipeline against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import ann, chat, langid, mixing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shared_out(sizes, weights=(5, 2, 1), most=3):
    """Targets by the stated steps: share, stop at the cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in give.items():
            target[s] += x
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"a": 0, "b": 7}, {"z": 3, "y": 0, "x": 900, "w": 1, "v": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = shared_out(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_mix(docs, rows, empty):
    mixed = mixing.mix(docs).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert sorted((str(r["doc_id"]), r["size"]) for r in mixed) == sorted((str(r[0]), n) for r, n in zip(rows, sizes))
    by_source = Counter()
    for r, n in zip(rows, sizes):
        by_source[r[3]] += n
    want, taken, largest = shared_out(by_source), Counter(), Counter()
    for r in mixed:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == by_source[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in by_source:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1 or abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mix_comes_near_many_small_documents(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text")
    )
    rows = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) <= 8 for r in rows)


EVENTS = "conv_id long, turn long, seq int, kind string, role string, text string"


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hello"), (1, 1, 0, "message", "assistant", ""), (1, 1, 1, "delta", None, "Hi "), (1, 1, 2, "delta", None, "there"),
        (1, 2, 0, "message", "user", "typo"), (1, 2, 1, "edit", None, "fixed"), (1, 3, 0, "message", "assistant", "bad"), (1, 3, 1, "regenerate", None, "x"),
        (1, 3, 2, "delta", None, "good"), (1, 3, 3, "delta", None, " end"), (1, 200, 0, "message", "user", "later"), (2, None, 0, "message", None, None),
        (None, 0, 0, "message", "user", "no id"), (1, 200, 1, "message", "user", "same turn"),
    ]
    got = chat.fold_events(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "chunk", "place").collect()
    texts = [(r["conv_id"], r["role"], r["text"]) for r in got]
    assert texts == [
        (None, "user", "no id"), (1, "user", "hello"), (1, "assistant", "Hi there"), (1, "user", "fixed"), (1, "assistant", "good end"), (1, "user", "later"),
        (1, "user", "same turn"), (2, "", ""),
    ]


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn>x\n", "\\b\\l\\\\", "", "a\n\nb", "</turn>\n<turn>user\nhi", "é🎯", "\\n<"]
    rows = [(c, t, 0, "message", ["user", "assistant", "a\nrole", "assistant"][t % 4], odd[(t * 3 + c) % len(odd)]) for c in range(3) for t in range(150)]
    rows += [(9, 5, 0, "message", "assistant", "tie b"), (9, 5, 0, "message", "assistant", "tie a"), (9, None, 0, "message", "user", None)]
    events = spark.createDataFrame(rows, EVENTS)
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[4], r[5] or ""))
        loss = "".join(r[5] or "" for r in turns if r[4] == "assistant")
        want[c] = (len(turns), sha("".join(f"{r[4]}\n{r[5] or ''}\n" for r in turns)), len(loss), sha(loss))
    got = {r["conv_id"]: r for r in chat.format_digests(events).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    for r in chat.render(chat.fold_events(events)).collect():
        assert all(r["formatted"][s["end"] :].startswith(chat.CLOSE) for s in r["loss"])
    assert chat.format_digests(events.limit(0)).count() == 0


def test_long_conversations_are_hashed_in_pieces(spark):
    rows = [(c, t, 0, "message", ["user", "assistant"][t % 2], f"é🎯<\\{t} " * (t % 7 * c)) for c in (1, 2, 30) for t in range(200)]
    rows += [(None, 1, 0, "message", "assistant", "no id " * 400), (4, 1, 0, "message", "user", None)]
    events = spark.createDataFrame(rows, EVENTS)
    want = sorted(map(tuple, chat.row_digests(events).collect()), key=str)
    for limit in (0, 5000, 60000, 1 << 30):
        assert sorted(map(tuple, chat.format_digests(events, limit).collect()), key=str) == want
    assert sorted(map(tuple, chat.stream_digests(events, 7).collect()), key=str) == want
    assert "collect_list(c" not in chat.stream_digests(events)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in chat.format_digests(events)._jdf.queryExecution().executedPlan().toString()


def test_language(spark, sf_dir, docs, rows, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op6_language(spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = langid.train(docs)
    scored = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(scored[i]["lang_pred"] == "und" and scored[i]["score"] == 0 for i in (300, 301, 302, 306)) and scored[303]["lang_pred"] in ("en", "fr")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def test_training_never_sees_held_out_rows(docs):
    poisoned = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.train(poisoned).languages


def test_temperature():
    logits = np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    assert langid.calibrate(logits, np.array([0, 0, 1, 1])) > 1.5
    assert langid.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def brute_neighbours(vectors, top):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in good:
        if q % 5 == 0:
            scores = [(-max(float(a @ good[q][0]) for a in vs), i) for i, vs in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, list int, vec string"


@pytest.mark.parametrize("settings", [ann.AnnSettings(), ann.AnnSettings(list_size=20, part=40, block=8)])
def test_neighbours(spark, settings):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    vectors += [(2000, None), (2005, [0.0] * 8), (2010, [nan] * 8), (2015, [inf] * 8), (2020, [1.0, None] + [1.0] * 6), (2025, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*v, 1, 2, "x") for v in vectors], VECTORS)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0, 20, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_neighbours(vectors, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert all(r == sorted(r, key=lambda x: (-x[1], x[0])) for r in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in exact[q])


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0], 0, 0, "") for i in range(4)], VECTORS)
    rows = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows] == [(1, 3, 5.0), (2, 2, 4.0), (3, 1, 3.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_pipeline(spark, sf_dir, docs, rows, empty):
    import corpus_pipeline as P

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.select(*names)
    kept = P.language(spark, table, sf_dir)
    assert kept.columns == names
    dropped = {str(r[0]) for r in rows} - {str(r["doc_id"]) for r in kept.collect()}
    assert dropped >= {"300", "301", "302", "306"} and not dropped & {str(i) for i in range(60)}
    one = P.near_duplicates(spark, table, sf_dir)
    ids = Counter(str(r["doc_id"]) for r in one.where("doc_id is not null").collect())
    assert one.columns == names and not ids.keys() & {str(100 + 6 * i) for i in range(10)} and set(ids.values()) == {1}
    assert P.personal_data(spark, table, sf_dir).columns == P.mixture(spark, table, sf_dir).columns == names
    coded = P.run(spark, sf_dir)
    assert coded.where("not round_trip").count() == 0 and coded.count() > 0
    for _, stage in P.STAGES:
        assert stage(spark, empty.select(*names), sf_dir).count() == 0
