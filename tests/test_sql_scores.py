"""sql_scores judges each distinct word of a group once."""

from prosemill.plans import queries as Q


def test_words_are_counted_before_they_are_judged(spark, tmp_path):
    docs = [(1, "never never Never rabble", "en", "a"), (2, "never", "en", "b"), (3, None, "fr", "a"), (4, "rabble 12", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.QUERIES["sql_scores"](spark, str(tmp_path))
    assert {tuple(r) for r in found.select("lang", "source", "words", "syllables", "most").collect()} == {("en", "a", 4, 8, 2), ("en", "b", 1, 2, 2), (None, None, 1, 2, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and dict(found.dtypes)["words"] == "bigint"
