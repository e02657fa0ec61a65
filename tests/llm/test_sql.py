"""Queries on documents against their SQL, on the given tables and on planted rows."""

from collections import Counter

import duckdb
import pytest
from helpers import SMALL

from tidepath.llm.oracle import ORACLE
from tidepath.llm.queries import QUERIES

PASSAGE = " ".join(f"shared{i}" for i in range(30))
DOCUMENTS = [
    (1, f"Start {PASSAGE} end\x85 of\x0cit"),
    (2, f"{PASSAGE}\n{PASSAGE} tail"),
    (3, f"two of {' '.join(PASSAGE.split()[:12])} too few"),
    (3, f"two of {' '.join(PASSAGE.split()[5:20])} enough"),
    (None, PASSAGE),
    (None, PASSAGE),
    (4, None),
    (5, " \t "),
    (6, "ÀB short-item; Ünder_score ITEM"),
]
ITEMS = [("b", PASSAGE.upper()), ("a", "short item"), ("c", ""), ("d", None), ("e", "ünder score item"), ("f", "short item")]


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op10_decontamination"])
@pytest.mark.parametrize("made", [False, True])
def test_same_as_sql(spark, tmp_path, name, made):
    folder = SMALL
    if made:
        folder = str(tmp_path)
        docs = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
        docs.toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{folder}/documents.parquet")
        items = spark.createDataFrame(ITEMS, "item_id string, text string")
        items.toPandas().to_parquet(f"{folder}/benchmark.parquet")
    engine = duckdb.connect()
    for table in ("documents", "benchmark"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours = QUERIES[name](spark, folder).toArrow()
    theirs = engine.sql(ORACLE[name]).to_arrow_table()
    names = sorted(theirs.column_names)
    assert sorted(ours.column_names) == names
    assert [ours.schema.field(n).type for n in names] == [theirs.schema.field(n).type for n in names]
    rows = [Counter(zip(*(t.column(n).to_pylist() for n in names))) for t in (ours, theirs)]
    assert rows[0] == rows[1]
