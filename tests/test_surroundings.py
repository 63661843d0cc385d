"""Options, guards, navigation, streaming and the registered queries."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill.operators import navigate as N
from prosemill.plans import options as O
from prosemill.sources import documents as D
from prosemill.streaming import revisions as R


def test_settings_are_repaired_and_stable():
    s = O.normalize_settings({"isPro": "yes", "longSentenceWords": 99, "veryLongSentenceWords": 10, "maxNoteChars": None, "rules": {"adverb": False, "gone": True, "hedge": "no"}, "ignoredWords": ["a", 3], "__proto__": {"isPro": True}})
    assert (s.is_pro, s.long_sentence_words, s.very_long_sentence_words, s.max_note_chars) == (False, 45, 46, 300_000)
    assert s.rules["adverb"] is False and s.rules["hedge"] is True and "gone" not in s.rules and s.ignored_words == ("a",)
    for raw in (None, 3, [], "x", {}):
        assert O.normalize_settings(raw) == O.Settings()
    assert O.normalize_settings({"longSentenceWords": float("nan"), "maxNoteChars": 1e9}).max_note_chars == 400_000
    assert O.pro_features() == ["deslop", "echo", "delta", "focus"]
    assert O.feature_enabled("unknown", False) and not O.feature_enabled("echo", False) and O.feature_enabled("echo", True)
    assert not O.RuleOptions().enabled("deslop") and O.RuleOptions(is_pro=True).enabled("deslop") and not O.RuleOptions({"adverb": False}).enabled("adverb")
    assert O.toggled(("a",), "a") == () and O.with_ignored(("b",), "a") == ("a", "b") == O.with_ignored(("a", "b"), "a")


def test_guard_and_changed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "abcd"), (4, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r["skip"] for r in D.guard(docs, 3, docs.where("doc_id = 3")).collect()}
    assert rows[1] is None and rows[4] is None and tuple(rows[2]) == ("too-large", 4, 3) and tuple(rows[3]) == ("muted", None, None)
    known = D.changed(docs, spark.createDataFrame([], "doc_id int, text_hash string")).where("doc_id < 3")
    assert {r["doc_id"] for r in D.changed(docs, known).collect()} == {3, 4}
    D.write_sections({"docs": docs}, str(tmp_path / "out"))
    assert D.read_table(spark, str(tmp_path / "out" / "docs")).count() == 4
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert D.read_files(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"


def test_navigation(spark):
    marks = spark.createDataFrame([(1, 5, 8, "adverb", "m1", "x"), (1, 20, 24, "weasel", "m2", "y"), (1, 30, 33, "adverb", "m3", "z")], "doc_id int, `from` int, `to` int, rule string, message string, word string")
    cursors = spark.createDataFrame([(1, 0), (1, 5), (1, 40)], "doc_id int, cursor int")
    ahead = {r["cursor"]: r["from"] for r in N.step_mark(marks, cursors).collect()}
    back = {r["cursor"]: r["from"] for r in N.step_mark(marks, cursors, False).collect()}
    assert ahead == {0: 5, 5: 20, 40: 5} and back == {0: 30, 5: 30, 40: 30}
    walks = spark.createDataFrame([(1, "adverb", 3)], "doc_id int, rule string, step int")
    assert N.nth_of_rule(marks, walks).first()["from"] == 30
    sentences = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "doc_id int, sent_idx int, `from` int, `to` int")
    at = spark.createDataFrame([(1, 10), (1, 15), (1, 99)], "doc_id int, cursor int")
    assert {r["cursor"]: r["sent_idx"] for r in N.sentence_at(sentences, at).collect()} == {10: 0, 15: 1}
    lengths = spark.createDataFrame([(1, 25)], "doc_id int, length int")
    focus = {r["cursor"]: [tuple(x) for x in r["ranges"]] for r in N.focus_ranges(sentences, at, lengths).collect()}
    assert focus == {10: [(10, 25)], 15: [(0, 10), (20, 25)]}
    found = N.mark_of_word(marks, spark.createDataFrame([(1, 21, "y")], "doc_id int, cursor int, word string"))
    assert found.first()["rule"] == "weasel"


@pytest.mark.parametrize(
    ("offset", "edits", "left", "right"),
    [
        (10, [(0, 0, 5)], 15, 15), (10, [(10, 10, 5)], 10, 15), (10, [(5, 15, 2)], 5, 7), (10, [(12, 14, 0)], 10, 10), (10, [(2, 4, 0), (8, 8, 3)], 8, 11),
    ],
)
def test_offsets_through_edits(spark, offset, edits, left, right):
    array = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(n).alias("insert")) for a, b, n in edits])
    row = spark.range(1).select(N.map_offset(F.lit(offset), array, -1), N.map_offset(F.lit(offset), array, 1)).first()
    assert tuple(row) == (left, right)


def _revisions():
    t0 = dt.datetime(2024, 1, 1)
    ms = dt.timedelta(milliseconds=1)
    return [(1, 1, t0, "a"), (1, 2, t0 + 100 * ms, "ab"), (1, 3, t0 + 349 * ms, "abc"), (1, 4, t0 + 900 * ms, "abc"), (2, 1, t0, "x")]


REVISION = "doc_id long, version long, ts timestamp, text string"


def test_debounce_batch(spark):
    rows = R.debounce(spark.createDataFrame(_revisions(), REVISION)).collect()
    assert {(r["doc_id"], r["version"], r["revisions"]) for r in rows} == {(1, 3, 3), (1, 4, 1), (2, 1, 1)}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    closing = [(9, 1, dt.datetime(2024, 1, 2), "late")]
    spark.createDataFrame(_revisions(), REVISION).write.parquet(source)
    stream = spark.readStream.schema(REVISION).parquet(source)
    q = R.debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame(closing, REVISION).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select doc_id, version from bursts").collect()
    assert {(r[0], r[1]) for r in rows} == {(1, 3), (1, 4), (2, 1)}


def test_queries_equal_their_sql(spark, sf_dir):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("documents", "conversations", "events", "pages"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    sql, queries = entry.oracle_sql(), entry.queries()
    for name in entry.prose.QUERIES:
        got = queries[name](spark, sf_dir)
        if name not in sql:
            assert got.count() >= 0
            continue
        want = con.sql(sql[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name

        def key(row):
            return tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)

        a = sorted(key(r[c] for c in columns) for r in got.collect())
        b = sorted(key(r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert a == b, name
    assert entry.entry(spark).count() > 0
