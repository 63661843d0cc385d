"""Pieces are cut once and passed on many at a time; fences are joined only in documents that leave one open."""

from prosemill.operators import split as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_without_open_fences_are_not_joined(spark):
    text = "\n\n".join(["The boats sank early that day in the harbour."] * 40)
    parts = spark.range(30).selectExpr("id doc_id", "0L part").selectExpr("*", f"'{text}' text".replace("\n", "\\n"))
    rows = S.split(parts, 200)
    plan = plan_of(rows)
    assert "Join" not in plan and "InArrow" not in plan and "ArrowEvalPython" not in plan
    assert rows.count() > 100 and rows.selectExpr("sum(length(text))").first()[0] == 30 * len(text)


def test_only_open_fences_are_mapped(spark):
    prose = "The boats sank early that day in the harbour.\n\n" * 40
    texts = {1: prose, 2: prose + "~~~\n" + prose + "~~~\n" + prose}
    parts = spark.createDataFrame([(d, 0, t) for d, t in texts.items()], "doc_id long, part long, text string")
    found = S.fenced(S.chunks(parts, 200)).orderBy("doc_id", "at").collect()
    for d, text in texts.items():
        own = [r for r in found if r["doc_id"] == d]
        assert "".join(r["text"] for r in own) == text
        assert [r["opener"] for r in own] == [S.OUTSIDE if text[: r["at"]].count("~~~") % 2 == 0 else "~~~" for r in own]
        assert {r["opener"] for r in own} == ({""} if d == 1 else {"", "~~~"})
