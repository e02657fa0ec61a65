"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tidepath.llm import queries, spelling
from tidepath.llm.common import read_table
from tidepath.llm.spelling import count_words, one_edit, shared_prefixes, spelling_variants

SMALL = "/root/testdata/sf0.001"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def neighbours(words):
    """Near words of each, through all strings made by taking out or masking one code point."""
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault(("del", w[:i] + w[i + 1 :]), set()).add(w)
            keys.setdefault(("sub", i, w[:i], w[i + 1 :]), set()).add(w)
        keys.setdefault(("del", w), set()).add(w)
    near = {w: set() for w in words}
    for group in keys.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    return near


def expected(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = neighbours(words)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    found = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        form = forms[w]
        found[w] = (form, root, n, len(near[w]), words[form] if form else None)
    return found


def damaged_counts(rows):
    total = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def as_table(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_scan_finds_all_words_one_edit_away():
    random.seed(2)
    words = sorted({"".join(random.choice("abé") for _ in range(random.randrange(7, 10))) for _ in range(900)})
    lcps = shared_prefixes(words)
    for query in words[::7] + ["aaaaaaa", "bbbbbbbb"]:
        for same in (3, 4):
            found = {words[at] for at in one_edit(words, lcps, query, same)}
            assert found == {w for w in words if is_near(w, query) and w[:same] == query[:same]}


def test_query_is_the_contract_on_given_rows(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]
    ours = queries.op11_spelling_variants(spark, SMALL)
    assert ours.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    table = as_table(ours)
    assert ours.count() == len(table) > 100
    assert table == expected(damaged_counts(rows))


def test_shards_ties_and_chains(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 40)
    random.seed(3)
    counts = Counter()
    for _ in range(400):
        counts["".join(random.choice("ab") for _ in range(random.randrange(7, 10)))] += random.choice([1, 3, 40, 900])
    # A chain of forms, and two forms of equal count.
    counts |= {"zzzzzzzz": 5000, "zzzzzzzy": 400, "zzzzzzxy": 30, "zzzzzwxy": 2}
    counts |= {"qqqqqqqq": 50, "qqqqqqqa": 50, "qqqqqqqb": 3}
    rows = [(w, n - 1) for w, n in counts.items() if n > 1] + [(w, 1) for w in counts]
    table = as_table(spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert table == expected(counts)
    assert table["zzzzzwxy"][1] == "zzzzzzzz" and table["qqqqqqqb"][0] == "qqqqqqqa"


def test_nulls_long_texts_and_clashing_names(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 3)
    long = "Différence différence differençe " * 4000 + "x" * 90_000 + " " + "x" * 90_000
    rows = [(1, None), (2, ""), (None, "Rivière RIVIÈRE riviere"), (3, long), (3, long), (4, "×÷àáâãäå 1234567 ab")]
    docs = documents(*rows, *rows)
    table = as_table(spelling_variants(count_words(docs, damage=31)))
    assert table == expected(damaged_counts([*rows, *rows]))
    assert as_table(spelling_variants(count_words(docs.limit(0)))) == {}
    nulls = spark.createDataFrame([(None, 5), (None, 6), ("abcdefg", 1), ("abcdefg", 1)], "word string, n long")
    assert as_table(spelling_variants(nulls)) == {"abcdefg": (None, "abcdefg", 2, 0, None)}
