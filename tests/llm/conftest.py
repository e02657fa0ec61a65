from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, key string, at long, n long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source); other columns have clashing names."""

    def build(*rows):
        full = [(*(*row, "en", "s")[:2], *(*row, "en", "s")[2:4], "k", 7, 8) for row in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def by_id(df, *columns):
    found = {}
    for row in df.collect():
        found.setdefault(row.doc_id if "doc_id" in df.columns else row.vec_id, []).append(
            tuple(row[c] for c in columns)
        )
    return found
