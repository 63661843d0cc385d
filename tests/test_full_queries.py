"""The full_ queries run every rule on a fixture whose counts are known."""

from prosemill.functions import lexicons as L
from prosemill.plans import queries as Q

TEXT = "Perhaps the river rose.\n\n```\nperhaps maybe\n```\n\nMaybe a win-win came. The {} grew."


def test_full_queries(spark, tmp_path):
    text = TEXT.format(next(w for w in L.MACHINE_WORDS if w.isalpha()))
    docs = [(1, text, "en", "s"), (2, "The cat sat.", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "The cat sat."), (1, 1, "user", text)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    counts = {(r["doc_id"], r["rule"]): r["n"] for r in Q.QUERIES["full_rule_counts"](spark, str(tmp_path)).collect()}
    assert counts == {(1, "hedge"): 2, (1, "cliche"): 1, (1, "deslop"): 1}
    legend = {(r["doc_id"], r["rule"]): r["n"] for r in Q.QUERIES["full_legend_counts"](spark, str(tmp_path)).collect()}
    assert len(legend) == 16 and {k: n for k, n in legend.items() if n} == counts
    whole = Q.QUERIES["full_corpus_rollup"](spark, str(tmp_path)).where("lang is null").first()
    assert (whole["marks"], whole["docs"]) == (4, 1)
    delta = {r["key"]: (r["before"], r["after"]) for r in Q.QUERIES["full_revision_delta"](spark, str(tmp_path)).collect()}
    assert (delta["hedge"], delta["cliche"], delta["deslop"]) == ((0, 2), (0, 1), (0, 1))
    assert Q.QUERIES["full_sentences"](spark, str(tmp_path)).where("doc_id = 1").count() == 3
    for name in ("sentence_bands", "variety", "monotone_runs", "echoes", "cursor_sentence"):
        Q.QUERIES[f"full_{name}"](spark, str(tmp_path)).collect()
