"""Quality rules against SQL, plain Python and fixed cases."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepath.llm import divergence, queries
from tidepath.llm.common import read_table
from tidepath.llm.divergence import keep_quality, quality_measures
from tidepath.llm.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def jensen_shannon(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    kl = lambda x, m: sum(i * math.log2(i / j) for i, j in zip(x, m) if i)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))


def rows_of(table):
    names = sorted(table.column_names)
    return Counter(zip(*(table.column(name).to_pylist() for name in names)))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, size):
    folder = SMALL.replace("sf0.001", size)
    ours = queries.op13_quality_rules(spark, folder).toArrow()
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = engine.sql(ORACLE["op13_quality_rules"]).to_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    assert [ours.schema.field(n).type for n in names] == [theirs.schema.field(n).type for n in names]
    assert rows_of(ours) == rows_of(theirs)


def test_good_documents_stay_and_bad_ones_go(spark):
    docs, labels = (read_table(spark, SMALL.replace("sf0.001", "sf0.01"), n) for n in ("documents", "labels"))
    found = quality_measures(docs).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(good) > 0.995 * len(good) and sum(bad) < 0.1 * len(bad)


WORDS = "the of and to in is it that for was on with as be by at from are this".split()
ODD = [
    None, "", " \t\n", "a b c d e f g h i", "a b c d e f g h i j", "a b c d e " * 3, "x\n\nx\n \nx\ny", "é# ü* |",
    "a b c d e f a b c d e g h i j k l m n o p", "line one two three four\nline one two three four\n" * 2,
    "a\x85b c d \x0be\x0cf", " ".join(WORDS * 40), "Q" * 300_000, "a b " * 60_000,
    " ".join(f"w{i % 5000}" for i in range(30_000)), " ".join(f"w{i}" for i in range(30_000)),
]


def test_counts_by_brute_force(spark, documents):
    docs = documents(*((i, text) for i, text in enumerate(ODD)), (None, ODD[4]), (3, ODD[8]))
    found = quality_measures(docs).select(F.col("row.text").alias("text"), *BASE).collect()
    assert len(found) == len(ODD) + 2
    for row in found:
        assert tuple(row[c] for c in BASE) == base_of(row.text), (row.text or "")[:40]


def test_distances_by_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_REFERENCE_WORDS", 100)
    texts = [(i, " ".join(WORDS[j % (5 + i)] + "." * (j % 3 == 0) for j in range(60 + i))) for i in range(12)]
    langs = ["en", "fr", None, "few"]
    rows = [(i, text, langs[i % 3] if i else "few", "s") for i, text in texts]
    found = {r.doc_id: r for r in quality_measures(documents(*rows)).select("row.*", "char_distance", "word_distance").collect()}
    size = lambda keep: sum(len(t.split()) for _, t, l, _ in rows if l == keep)
    for i, text, lang, _ in rows:
        same = [t for _, t, l, _ in rows if l == lang] if size(lang) >= 100 else [t for _, t, _, _ in rows]
        counts = Counter(w for t in same for w in t.split())
        top = sorted(counts, key=lambda w: (-counts[w], w))[: divergence.COMMON_WORDS]
        own = Counter(text.split())
        cells = lambda c: [*(c[w] for w in top), sum(c.values()) - sum(c[w] for w in top)]
        assert found[i].word_distance == pytest.approx(jensen_shannon(cells(own), cells(counts)))

        def chars(c):
            text = "".join(w * n for w, n in c.items())
            kinds = [sum(x.isascii() and x.isupper() for x in text), 0, text.count("."), 0]
            return [*kinds, len(text) - sum(kinds), 0]

        assert found[i].char_distance == pytest.approx(jensen_shannon(chars(own), chars(counts)))


def test_rows_come_back_whole_and_empty_tables_stay_empty(spark, documents):
    good = " ".join(f"{a} {b}." for a in WORDS for b in WORDS)
    full = [(i, f"{good} {i}", "en", "s", "x", True, 0.5, 3) for i in range(8)] + [(9, "no", "en", "s", "x", True, 0.5, 3)]
    names = "doc_id long, text string, lang string, source string, row string, kept boolean, word_distance double, words long"
    docs = spark.createDataFrame([*full, full[0]], names)
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([*full[:8], full[0]])
    assert quality_measures(docs.limit(0)).collect() == []
    assert keep_quality(docs.limit(0)).collect() == []


def test_no_python_workers(spark):
    found = queries.op13_quality_rules(spark, SMALL)
    plan = found._jdf.queryExecution().toString()
    for unwanted in ("Python", "Arrow", "Cartesian", "NestedLoop"):
        assert unwanted not in plan
