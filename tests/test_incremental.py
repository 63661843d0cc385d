"""Incremental scans without an exchange of texts, and all sections from one scan."""

from prosemill.operators.scan import FIELDS
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions
from prosemill.sources import documents as D


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changed_in_place(spark):
    docs = spark.range(400).selectExpr("id doc_id", "if(id % 50 = 0, null, concat('text ', id)) text", "'x' lang")
    spark.sql("drop table if exists kept_docs")
    spark.sql("drop table if exists kept_hashes")
    kept = D.keep_bucketed(docs, "kept_docs", 8)
    known = D.keep_bucketed(D.hashes(docs.where("doc_id % 4 <> 0").selectExpr("doc_id", "if(doc_id % 7 = 0, 'old', text) text")), "kept_hashes", 8)
    found = D.changed_in_place(kept, known)
    assert "Exchange" not in plan_of(found)
    assert found.columns == ["doc_id", "text", "lang", "text_hash"]
    assert {r["doc_id"] for r in found.collect()} == {i for i in range(400) if i % 4 == 0 or i % 7 == 0}
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in D.changed(docs, known).collect()}
    for name in ("kept_docs", "kept_hashes"):
        spark.sql(f"drop table {name}")


def test_sections_from_one_scan(spark, tmp_path):
    texts = ["The net was torn by Anna. It sank slowly — deep — and — gone.", "# Heading\n\n`code` is is here.", None, "", "At the end of the day we delve into it. " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    engine = ProseEngine(docs, RuleOptions(is_pro=True, ignored_words=("slowly",)))
    stored = engine.kept(f"file://{tmp_path}/scan")
    for name, frame in stored.sections().items():
        assert "MapInArrow" not in plan_of(frame), name
        assert sorted(map(str, frame.collect())) == sorted(map(str, engine.sections()[name].collect())), name
    assert set(stored.store.columns) == {"doc_id", *FIELDS}
    engine.write_sections(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/marks").count() == engine.marks.count() > 0
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"scan", *engine.sections()}


def test_marks_are_one_scan_without_exchange(spark, sf_dir):
    from prosemill.plans import queries as Q

    for name in ("marks", "markdown_readability", "echoes", "legend_counts"):
        plan = plan_of(Q.QUERIES[name](spark, sf_dir))
        assert plan.count("MapInArrow") == 1 and "ArrowEval" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM"), name
