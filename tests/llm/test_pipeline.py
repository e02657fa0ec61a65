"""The pipeline's stages, one after the other."""

from collections import Counter

import corpus_pipeline
from tidepath.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
# The smallest folder with documents that the toxicity stage rejects.
MEDIUM = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read_table(spark, MEDIUM, "documents").cache()
    columns = docs.columns
    before = {row.doc_id: row.text for row in docs.collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MEDIUM).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[0] < len(before)
    kept = {row.doc_id: row.text for row in docs.collect()}
    assert len(kept) == sizes[-1] and set(kept) <= set(before)
    mixed = Counter(row.doc_id for row in corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).collect())
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
