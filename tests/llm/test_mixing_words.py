"""Word counts of the mix against the pattern they are defined by."""

import re

from pyspark.sql import functions as F

from tidepath.llm.mixing import n_words

TEXTS = [
    None, "", " ", "a", " a b ", "a \x85", "a\u2028", "a \u2028", "a \u2029", "a\n", "a \r\n", "\x85 a\x85\n",
    "a\x0bb\x0cc\x85d", "\n\n", "a \n\u2029\n",
]


def test_line_terminators_beyond_white_space_are_words(spark):
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)], "i int, text string")
    found = {r.i: r.n for r in rows.select("i", n_words(F.col("text")).alias("n")).collect()}
    assert found == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
