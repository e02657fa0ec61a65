"""The sampled part of a mix against a plain computation of the same draw."""

import hashlib
import random
from math import isclose, sqrt

from tidepath.llm.mixing import mix_sources, mixed_documents


def draw(doc_id, seed=17):
    return (int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def scale_of(sizes, rest):
    """By halving: the scale at which the expected words are those left."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * min(1, mid / sqrt(s)) for s in sizes) < rest else (low, mid)
    return low


def test_draw_against_plain_computation(documents):
    rng = random.Random(5)
    docs, number = [], 0
    for source, many in (("a", 300), ("b", 40), ("c", 900), (None, 25), ("e", 1)):
        for _ in range(many):
            size = rng.choice([0, 1, 2, 3, 5, 8, 40, 400])
            docs.append((number, " ".join(["w"] * size), "en", source))
            number += 1
    found = {row.doc_id: row for row in mix_sources(documents(*docs)).collect()}
    assert len(found) == len(docs)
    for source in ("a", "b", "c", None, "e"):
        rows = [row for row in found.values() if row.source == source]
        some = rows[0]
        whole = int(some.target // some.source_size) if some.source_size else 0
        rest = some.target - whole * some.source_size
        drawn = [row for row in rows if row.size > 0]
        expected = set()
        if rest > 1e-9 and drawn:
            scale = scale_of([row.size for row in drawn], rest)
            chances = {row.doc_id: scale / sqrt(row.size) for row in drawn}
            assert isclose(sum(row.size * min(1, chances[row.doc_id]) for row in drawn), rest, rel_tol=1e-6)

            def rank(row):
                p = chances[row.doc_id]
                u = draw(row.doc_id)
                return (0 if p >= 1 - 1e-9 else u / (1 - u) * (1 - p) / p, row.doc_id)

            total = 0
            for row in sorted(drawn, key=rank):
                total += row.size
                if total - row.size / 2 <= rest:
                    expected.add(row.doc_id)
        for row in rows:
            assert row.copies == whole + (row.doc_id in expected)
            assert row.taken <= 2 * row.size
        assert abs(sum(row.taken for row in rows) - some.target) <= 200


def test_small_targets_and_clashing_names(spark):
    rows = [(i, "one two three", "big" if i < 2000 else "small", "x", "y", "z") for i in range(2100)]
    names = "doc_id long, text string, source string, times string, taken_id string, copy string"
    docs = spark.createDataFrame(rows, names)
    found = mix_sources(docs, weights=(1.0, 2000.0), share=0.02, most=2.0).collect()
    big = [row for row in found if row.source == "big"]
    assert abs(sum(row.taken for row in big) - big[0].target) <= 3
    mixed = mixed_documents(docs, weights=(1.0, 2000.0), share=0.02)
    assert mixed.columns == ["doc_id", "text", "source", "times", "taken_id", "copy"]
    assert {(row.times, row.taken_id) for row in mixed.collect()} == {("x", "y")}
    assert dict(mixed.dtypes)["copy"] == "int" and mixed.where("copy < 1").count() == 0
