"""The word at a cursor that stands right after a line end."""

import pytest
from pyspark.sql import functions as F

from prosemill.functions.text import word_at


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", "\u0085", " "])
def test_word_after_line_end(spark, end):
    rows = spark.createDataFrame([("ab" + end + "cd", 2 + len(end)), ("ab" + end, 2 + len(end)), ("ab" + end, 2), ("o'er-all" + end, 5)], "line string, at int")
    assert [r[0] for r in rows.select(word_at(F.col("line"), F.col("at"))).collect()] == ["cd", None, "ab", "o'er-all"]


def test_word_in_a_long_run(spark):
    row = spark.range(1).select(word_at(F.concat(F.lit(". "), F.repeat(F.lit("a-"), 200_000), F.lit("! b")), F.lit(200_000)).alias("w")).first()
    assert len(row["w"]) == 399_999
