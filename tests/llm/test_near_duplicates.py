"""Near-duplicate groups against all pairs, on texts that are hard to tell apart."""

from __future__ import annotations

import random

import pytest

from tidepath.llm import ordered_minhash
from tidepath.llm.ordered_minhash import aligned, keep_one_per_group, near_duplicates

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def brute_force(texts: dict[int, str]) -> dict[int, int]:
    """The smallest id reachable by links between texts of similarity 0.8 or more."""
    runs = {}
    for at, text in texts.items():
        words = text.split()
        size = min(5, len(words)) or 1
        runs[at] = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    group = {at: at for at in texts}

    def find(at: int) -> int:
        while group[at] != at:
            at = group[at]
        return at

    for a in texts:
        for b in texts:
            if a < b and runs[a] and runs[b] and aligned(runs[a], runs[b]):
                low, high = sorted((find(a), find(b)))
                group[high] = low
    return {at: find(at) for at in texts}


def vary(rng: random.Random, words: list[str], edits: int, kinds: str = "rid") -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice(kinds)
        if kind == "r":
            words[at] = "".join(rng.choices(LETTERS, k=3))
        elif kind == "i":
            words.insert(at, "".join(rng.choices(LETTERS, k=3)))
        elif len(words) > 1:
            del words[at]
    return words


def hard_texts(seed: int) -> dict[int, str]:
    """Copies of one text a little or far off, copies of those, cut and reordered ones."""
    rng = random.Random(seed)
    fresh = lambda n: ["".join(rng.choices(LETTERS, k=4)) for _ in range(n)]
    base = fresh(120)
    made = [base]
    for _ in range(70):
        made.append(vary(rng, base, rng.randrange(1, 9)))
    far = [words for words in made if len(set(base) - set(words)) > 4]
    for words in far[:15]:
        made.append(vary(rng, words, 2))
    for cut in range(60, 120, 5):
        made.append(base[:cut])
        made.append(vary(rng, base[:cut], 2, "d"))
    for _ in range(5):
        turned = base[60:] + base[:60]
        made.append(vary(rng, turned, 2))
        made.append(base[:40] + base[80:] + base[40:80])
    passage = fresh(40)
    for _ in range(10):
        made.append(vary(rng, base[:60] + passage + base[60:], 3))
    rng.shuffle(made)
    return {number: " ".join(words) for number, words in enumerate(made)}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_hard_texts(spark, seed):
    texts = hard_texts(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    assert found == brute_force(texts)
    assert 10 < len(set(found.values())) < len(found)


def test_short_texts_lose_no_pair(spark):
    rng = random.Random(3)
    texts = {}
    for length in range(5, 30):
        for _ in range(12):
            words = ["".join(rng.choices(LETTERS, k=4)) for _ in range(length)]
            for copy in (words, words[:-1], words[1:], [*words, "end"]):
                texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    expected = brute_force(texts)
    short = [at for at, text in texts.items() if len(text.split()) <= 18]
    assert {at: found[at] for at in short} == {at: expected[at] for at in short}
    assert sum(found[at] != expected[at] for at in texts) <= 2


def test_rows_that_share_an_id_and_odd_rows(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices(LETTERS, k=4)) for _ in range(60)]
    near = " ".join([*base, "end"])
    rows = [
        (1, " ".join(base), "x"), (1, "some quite other words in a row", "x"), (2, near, None),
        (3, "some quite other words in a row", "x"), (None, near, "y"), (4, None, "z"),
        (5, "", "z"), (6, " \n\t", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lead string")
    found = {(r.doc_id, r.group_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == {
        (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (4, 4, True),
        (5, 5, True), (6, 6, True),
    }
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 4, 5, 6]


@pytest.mark.parametrize("most", [ordered_minhash.GROUP_BYTES, 3_000])
def test_extras_of_one_text_are_not_dealt_out(spark, monkeypatch, most):
    """Two texts share an inserted passage; all others have insertions of their own."""
    monkeypatch.setattr(ordered_minhash, "GROUP_BYTES", most)
    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choices(LETTERS, k=6)) for _ in range(n)]
    base, passage = fresh(60), fresh(8)
    texts = [base, *(base[:30] + fresh(8) + base[30:] for _ in range(40))]
    texts += [base[:at] + passage + base[at:] for at in (20, 40)]
    docs = [(at, " ".join(words), 6 * len(words)) for at, words in enumerate(texts)]
    pairs = [(0, at) for at in range(1, len(texts))]
    found = ordered_minhash._differences(
        spark.createDataFrame(docs, "at long, text string, size long"),
        spark.createDataFrame(pairs, "lead long, other long"),
    ).collect()
    assert sorted(row["at"] for row in found) == [at for _, at in pairs]
    assert {(row.n_lead, row.n, row.missing, row.n_extras) for row in found} == {(56, 64, 4, 12)}
    extras = {row["at"]: set(row.extras) for row in found}
    assert len(extras[41] & extras[42]) == 4
    if most > 3_000:  # the lead's others are one group
        assert extras[41] == extras[42] and not any(extras[at] for at in range(1, 41))
    else:
        assert all(len(some) == 12 for some in extras.values())


def test_groups_of_hard_texts_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered_minhash, "GROUP_BYTES", 3_000)
    texts = hard_texts(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    assert found == brute_force(texts)
