"""Word hashes made for whole slices of texts, and repeats among words that are hard to hash."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tidepath.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "ab\x1c\x1f\x85\xa0　\xe9\0 \t\n\r\x0b\x0c"


def odd_texts(seed, many):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(80))) for _ in range(many)]


def test_words_of_a_slice_are_hashed_at_once():
    edges = ["abcdefgh abcdefgh\0 abcdefghi", "x" * 64, "x" * 65, "x" * 63 + " " + "y" * 200]
    texts = [None, "", " \t\n\x0b\x0c\r", *edges, *odd_texts(1, 2000)]
    for column in (pa.array(texts), pa.array(texts).slice(3, 900), pa.array([], pa.string())):
        begins, hashes = substrings.word_hashes(column)
        words = [WORD.findall(text or "") for text in column.to_pylist()]
        assert np.diff(begins).tolist() == [len(some) for some in words]
        flat = [word for some in words for word in some]
        seen = dict(zip(flat, hashes.tolist()))
        assert [seen[word] for word in flat] == hashes.tolist()
        assert len(set(seen.values())) == len(seen)


def test_no_window_spans_two_texts():
    begins, words = substrings.word_hashes(pa.array(["a b c", None, "d", "e f g h"]))
    text, place = substrings.windows_of(begins, 3)
    assert list(zip(text.tolist(), place.tolist())) == [(0, 0), (3, 0), (3, 1)]
    keys = substrings.window_keys(words, 2, 3)
    known = [[], [], [], [int(keys[begins[3] + 1].view(np.int64))]]
    passed = [(2, pa.array(known, pa.list_(pa.int64())))]
    text, place = substrings.surviving(begins, words, 3, passed)
    same = keys[begins[3]] == keys[begins[3] + 1]
    assert list(zip(text.tolist(), place.tolist())) == ([(3, 0), (3, 1)] if same else [(3, 1)])


def test_repeats_of_odd_words(documents):
    texts = odd_texts(2, 60)
    long = " ".join("z" * size for size in range(55, 75))
    rows = [(i, text + " " + texts[i % 7] * 3) for i, text in enumerate(texts)]
    rows += [(70, long), (71, "start " + long.replace(" ", "\n")), (None, long + " end"), (72, None)]
    first, expected = {}, []
    split = [(2**63 - 1 if i is None else i, WORD.findall(text or "")) for i, text in rows]
    for i, some in split:
        for k in range(len(some) - 12):
            first[tuple(some[k : k + 13])] = min(i, first.get(tuple(some[k : k + 13]), i))
    for i, some in split:
        gone = [False] * len(some)
        for k in range(len(some) - 12):
            if first[tuple(some[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(word for word, drop in zip(some, gone) if not drop)
        expected.append((len(some), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substrings.remove_repeats(documents(*rows)).select("n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(expected)
