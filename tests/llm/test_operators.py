"""Every operator against brute force or fixed cases, with nulls, empties, ties and repeats."""

import hashlib
import random
import re
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import line_dedup
from tidepath.llm import langid, ordered_minhash, vectors
from tidepath.llm.components import components
from tidepath.llm.contamination import find_benchmark, remove_contaminated
from tidepath.llm.language_model import pack, score_texts, seat, unpack
from tidepath.llm.lines import dedup_lines
from tidepath.llm.mixing import mix_sources, mixed_documents
from tidepath.llm.ordered_minhash import aligned, keep_one_per_group, near_duplicates
from tidepath.llm.queries import QUERIES
from tidepath.llm.substrings import remove_repeats
from tidepath.llm.tokens import count_tokens, load_lengths
from tidepath.llm.toxicity import Scorer, remove_toxic, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def by_id(df, *columns):
    key = df.columns[0]
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append(tuple(row[c] for c in columns))
    return found


def words(seed, n, kinds=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "one two"), (5, "one two"), (5, "one two")]


def test_token_counts(documents):
    texts = ["It's <|endoftext|> here", "ÇA  va bien", "x" * 300, words(1, 3000), "a\x1cb ½"]
    docs = documents(*ODD, *((10 + i, t) for i, t in enumerate(texts)))
    found = by_id(count_tokens(docs, TOKENIZER), "n_bytes", "n_tokens", "over_limit")
    whole = load_lengths(TOKENIZER)
    for i, text in enumerate(texts):
        n = whole([text])[0]
        assert found[10 + i] == [(len(text.encode()), n, n > 2048)]
    assert found[1] == found[2] == [(0, 0, False)]
    assert len(found[5]) == 2 and len(found[None]) == 1
    assert count_tokens(docs.limit(0), TOKENIZER).count() == 0


def test_language_gradients_match_differences():
    model = langid.Gru.fresh(3, 2, seed=1)
    for group in (model.inputs, model.loops, model.heads):
        group[:] = [w.astype(np.float64) for w in group]
    data, label = np.array([[97, 98, 99], [98, 97, 97]]), np.array([0, 1])
    slopes, _ = model.gradients(data, label)
    for weight, slope in zip(model.weights(), slopes):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        before, step = weight[at], 1e-3
        weight[at] = before + step
        up = model.gradients(data, label)[1]
        weight[at] = before - step
        down = model.gradients(data, label)[1]
        weight[at] = before
        assert slope[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-5)


def test_language(documents):
    rng = random.Random(3)

    def text(parts):
        return " ".join("".join(rng.choices(parts, k=3)) for _ in range(30))

    one, two = ["the", "ing", "er"], ["que", "eau", "ou"]
    rows = [(i, text(two if i % 2 else one), "b" if i % 2 else "a") for i in range(80)]
    docs = documents(*rows, *((900 + (i or 0), t, None) for i, t in ODD), (999, "123 ...", "a"))
    found = by_id(langid.predict_language(docs, F.col("doc_id") % 5 != 0), "lang_pred", "score")
    held = [(i, lang) for i, _, lang in rows if i % 5 == 0]
    assert sum(found[i][0][0] == lang for i, lang in held) >= 0.9 * len(held)
    assert found[999] == found[901] == found[902] == [("und", 0.0)]
    nothing = by_id(langid.predict_language(docs, F.lit(False)), "lang_pred")
    assert set(sum(nothing.values(), [])) == {("und",)}
    assert langid.predict_language(docs.limit(0), F.lit(True)).count() == 0


def test_scores(documents):
    texts = {i: words(i, 60, kinds=30) for i in range(40)}
    docs = documents(*texts.items(), (100, None), (101, ""), (107, "Zzz"), (None, "w1"), (7, texts[7]))
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(True))
    rows = score_texts(docs, held).collect()
    assert len(rows) == 45
    counts = Counter()
    for row in docs.where(~held).collect():
        counts.update([*(row.text or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for row in rows:
        assert row.train_tokens == n
        if row.doc_id in texts:
            tokens = [*texts[row.doc_id].split(), None]
            base = sum(log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
            assert row.base_score == pytest.approx(base)
            assert (row.n_tokens, row.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
    one = {row.doc_id: row for row in rows}
    assert one[100].n_tokens == one[101].n_tokens == 1 and one[107].n_known == 1
    assert all(row.score < 0 for row in rows)
    assert score_texts(docs.limit(0), held).count() == 0


def test_scores_tell_whole_words_before_apart(documents):
    # Both words before end in the same two bytes, and both words after are as frequent.
    rows = [(i, ("warm rain", "farm gate")[i % 2] + f" w{i % 5}") for i in range(80)]
    rows += [(100, "warm rain w1"), (101, "warm gate w1"), (102, "farm gate w1"), (103, "farm rain w1")]
    found = {row.doc_id: row.score for row in score_texts(documents(*rows), F.col("doc_id") >= 100).collect()}
    assert min(found[100], found[102]) > max(found[101], found[103]) + 1


def test_seating_keeps_its_bounds():
    counts = np.array([0, 1, 2, 70, 5000])
    tables = seat(counts, np.full(5, 0.5), 0.7, np.random.default_rng(1))
    assert tables[0] == 0 and tables[1] == 1
    assert (tables[1:] >= 1).all() and (tables <= counts).all()
    some = np.array([1, 70000, 3], np.uint32)
    assert (unpack(pack(some), np.uint32) == some).all()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    near = base[:20] + rng.normal(size=(20, 64)) * 0.05
    all_vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), (3 * base[1]).tolist()]
    rows = [(i, v) for i, v in enumerate(all_vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None, 1.0]), (905, [1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, n long, node long")
    found = by_id(vectors.near_vectors(df), "n_links", "component_id", "kept")
    x = np.array(all_vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    got = sum(found[i][0][0] for i in range(len(rows)))
    assert 0.9 * linked.sum() <= got <= linked.sum()
    assert found[80][0][1] == 0 and found[81][0][1] == 1 and not found[80][0][2]
    for i, _ in odd:
        assert found[i] == [(0, i, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 50), (60, 60), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = dict(components(df).collect())
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40}


def brute_repeats(rows, window=13):
    texts = [(2**63 - 1 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, some in texts:
        for k in range(len(some) - window + 1):
            key = tuple(some[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, some in texts:
        gone = [False] * len(some)
        for k in range(len(some) - window + 1):
            if first[tuple(some[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(some, gone) if not g)
        out.append((len(some), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(documents):
    shared = words(50, 30)
    rows = [(i, words(i, 40) + ("  \n" + shared if i % 3 == 0 else "") + " " + words(i + 500, 9)) for i in range(20)]
    rows += [(30, rows[4][1]), (31, rows[4][1].replace(" ", "\t")), (32, "a " * 60), (33, "a " * 40), *ODD]
    rows += [(34, words(7, 13)), (35, words(7, 12)), (3, shared)]
    found = remove_repeats(documents(*rows)).select("n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == brute_repeats(rows)
    assert remove_repeats(documents(*rows).limit(0)).count() == 0


def test_lines(documents):
    long = "a line of more than twenty-four characters"
    docs = documents(
        (1, f"{long}\nshort\n\nshort"),
        (2, f"{long}!\nshort\nother\n"),
        (3, f"{long[:5]}X{long[5:]}\nshorx\n \n "),
        (4, f"{long}!?\nnew"),
        (5, None),
        (6, ""),
        (None, "new\nlast"),
        (4, f"{long}!?\nnew"),
    )
    found = by_id(dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "key"), "text", "n_lines", "n_removed")
    assert found[1] == [(f"{long}\nshort\n", 4, 1)]
    assert found[2] == [("other\n", 4, 2)]
    assert found[3] == [("shorx\n \n ", 4, 1)]
    # Two edits from the first, but one from the line of document 2.
    assert found[4] == [("new", 2, 1)] * 2
    assert found[5] == [(None, 0, 0)] and found[6] == [("", 0, 0)]
    assert found[None] == [("last", 2, 1)]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_other_ids_clashing_names_and_many_lines(documents, spark):
    rows = [("b", "one\ntwo"), ("a", "two"), (None, "one\nnew"), (None, "new\nown"), ("z", "one")]
    names = "doc_id string, text string, line string, at string, h string, mask string, kept string, n_removed string"
    docs = spark.createDataFrame([(*row, "l", "a", "h", "m", "k", "n") for row in rows], names)
    found = dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "line", "at", "h", "mask", "kept", "n_lines", "n_removed"]
    kept = sorted((row.doc_id or "", row.text, row.line, row.kept, row.n_removed) for row in found.collect())
    # Rows without an id are one last document: what only they have stays in both.
    assert kept == [
        ("", "new", "l", "k", 1),
        ("", "new\nown", "l", "k", 0),
        ("a", "two", "l", "k", 0),
        ("b", "one", "l", "k", 1),
        ("z", "", "l", "k", 1),
    ]
    many = [f"line {i * 7}" if i % 3 else "" for i in range(20_000)]
    found = by_id(dedup_lines(documents((1, "\n".join(many[::2])), (2, "\n".join(many)))).select("doc_id", "text"), "text")
    assert found[1] == [("\n".join(many[::2]),)]
    first = {line for line in many[::2] if line}
    assert found[2] == [("\n".join(line for line in many if line not in first),)]


def test_near_lines_against_brute_force(documents):
    rng = random.Random(8)
    lines = []
    for _ in range(25):
        line = list(words(rng.random(), 9))
        lines.append("".join(line))
        for _ in range(3):
            copy, at = line[:], rng.randrange(len(line))
            copy[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "é"])
            lines.append("".join(copy))
    rng.shuffle(lines)
    found = by_id(dedup_lines(documents(*enumerate(lines))).select("doc_id", "n_removed"), "n_removed")

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])

    for i, line in enumerate(lines):
        gone = any(near(line, other) for other in lines[:i])
        assert found[i] == [(int(gone),)], line


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, one in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (one != other))
    return row[-1]


def test_near_lines_on_both_sides_of_the_shortest(documents):
    long = "exactly twenty-four long"
    docs = documents((1, long[1:]), (2, long), (3, f"other {long[6:]}"), (4, f"othr {long[6:]}"))
    found = by_id(dedup_lines(docs).select("doc_id", "text"), "text")
    # The longer line goes after the shorter one, which must be equal to go itself.
    assert found == {1: [(long[1:],)], 2: [("",)], 3: [(f"other {long[6:]}",)], 4: [(f"othr {long[6:]}",)]}


def test_near_lines_of_any_length_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(1)
    lines = ["".join(rng.choices("abé🙂 7", k=rng.randint(1, 9))) for _ in range(150)]
    lines = [line for line in lines if line.strip(" ")]
    documents(*enumerate(lines)).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(QUERIES["op6_line_dedup"](spark, str(tmp_path)), "n_removed")
    for i, line in enumerate(lines):
        gone = any(distance(line, other) <= 1 for other in lines[:i])
        assert found[i] == [(int(gone),)], line


def test_queries_compare_lines_of_any_length(spark, documents, tmp_path):
    docs = documents(
        (1, "A1\nshort\n\nline 139993"),
        (2, "A2\nshorx\n\nline 139995\nkept"),
        (3, "shirx\n \nkeep it\nkept"),
        (None, "kep\nshorter line, 23 chars"),
        (7, "shorter line of 23 chars\nshorter line, 23 chars!"),
        (8, None),
        (8, ""),
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {1: "A1\nshort\n\nline 139993", 2: "\nkept", 3: " \nkeep it", None: "", 7: "shorter line of 23 chars\nshorter line, 23 chars!"}
    found = by_id(QUERIES["op6_line_dedup"](spark, str(tmp_path)), "n_lines", "n_removed", "kept_sha256")
    lines = {1: (4, 0), 2: (5, 3), 3: (4, 2), None: (2, 2), 7: (2, 0)}
    for key, text in left.items():
        assert found[key] == [(*lines[key], hashlib.sha256(text.encode()).hexdigest())]
    assert found[8] == [(0, 0, hashlib.sha256(b"").hexdigest())] * 2
    staged = by_id(line_dedup(spark, docs, str(tmp_path)).select("doc_id", "text"), "text")
    assert {key: value for key, value in staged.items() if key != 8} == {k: [(t,)] for k, t in left.items()}
    assert sorted(staged[8], key=str) == [("",), (None,)]


def test_toxic_clauses(documents, spark):
    scorer = Scorer({"idiot$": 3.0, "lowe": 2.0})
    plain = scorer.features("the idiot here")
    assert plain == scorer.features("The IDIOT### here")
    assert scorer.features("you are an idiot") != plain != scorer.features("not an idiot")
    assert scorer.features("they said the idiot came") != scorer.features("they came. the idiot")
    assert sum(scorer.features("loweien")) > 0 == sum(scorer.features("clean kill"))
    assert sum(scorer.features("kill you")) == 0 < sum(scorer.features("you kill"))
    rows = [(i, words(i, 20) + (" clown " if i % 4 == 0 else " kind ") + words(i + 99, 5)) for i in range(120)]
    docs = documents(*rows, (None, "clown"), (200, None), (201, ""), (1, rows[1][1]))
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0), 1) for i, _ in rows] + [(None, 1, 1), (5, None, 1)],
        "doc_id long, toxic int, quality int",
    )
    learn = F.col("doc_id") % 3 != 0
    found = by_id(score_toxicity(docs, labels, learn), "score", "predicted")
    assert all(found[i][0][1] == int(i % 4 == 0) for i, _ in rows)
    assert found[200] == found[201] and found[200][0][1] == 0 and found[None][0][1] == 1
    kept = {row.doc_id for row in remove_toxic(docs, labels, learn).collect()}
    assert kept == {i for i, _ in rows if i % 4} | {200, 201}
    assert score_toxicity(docs.limit(0), labels.limit(0), learn).count() == 0


def brute_similarity(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1] / (len(a) + len(b) - best[-1][-1])


def test_alignment_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randrange(1, 40))]
        b = a[:]
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
        if b:
            exact = brute_similarity(a, b)
            assert aligned(a, b) == pytest.approx(exact if exact >= 0.8 - 1e-12 else 0.0)


def test_near_duplicates(documents):
    base = {i: words(1000 + i, 200, kinds=5000).split() for i in range(12)}
    rows = [(i, " ".join(some)) for i, some in base.items()]
    for i in range(6):
        copy = base[i][:]
        copy[50] = "changed"
        rows += [(100 + i, " ".join(copy)), (200 + i, "  ".join(base[i]))]
    far = base[7][:]
    far[::9] = ["other"] * len(far[::9])
    rows += [(300, " ".join(far)), (301, " ".join(base[8][100:] + base[8][:90])), *[(400 + (i or 0), t) for i, t in ODD[:3]]]
    rows += [(None, "one two"), (5, rows[5][1])]
    docs = documents(*rows)
    found = by_id(near_duplicates(docs), "group_id", "kept")
    for i in range(6):
        assert {g for g, _ in found[i] + found[100 + i] + found[200 + i]} == {i}
        assert found[100 + i][0][1] is False
    for alone in (7, 8, 300, 301, 401, 402, 403, None):
        assert found[alone][0] == (alone, True)
    kept = Counter(row.doc_id for row in keep_one_per_group(docs).collect())
    assert kept[5] == 2 and not kept[100] and kept[300] == kept[None] == 1
    assert near_duplicates(docs.limit(0)).count() == 0


def test_sketches_share_with_the_expected_chance():
    hashes = ordered_minhash.mix(np.arange(1, 400, dtype=np.uint64))
    other = np.concatenate([hashes[:350], hashes[:30]])
    assert set(ordered_minhash.sketches(hashes)) & set(ordered_minhash.sketches(other))
    assert ordered_minhash.sketches(hashes[::-1].copy()) != ordered_minhash.sketches(hashes)
    assert ordered_minhash.sketches(hashes[:0]) == []


def test_mix(documents):
    rng = random.Random(5)
    rows = [(i, words(i, rng.randrange(1, 60)), "en", f"s{i % 4}" if i % 4 else None) for i in range(400)]
    rows += [(1000, None, "en", "s1"), (1001, "", "en", "empty"), (7, rows[7][1], "en", rows[7][3])]
    docs = documents(*rows)
    found = mix_sources(docs).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    total = sum(row.size for row in found)
    taken, target, sizes = Counter(), {}, Counter()
    for row in found:
        taken[row.source] += row.taken
        sizes[row.source] += row.size
        target[row.source] = row.target
        assert row.taken in (0, row.size, 2 * row.size)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for source in target:
        assert target[source] <= 2 * sizes[source]
        assert abs(taken[source] - target[source]) <= 60
    copies = Counter(row.doc_id for row in mixed_documents(docs).collect())
    assert sum(copies[row.doc_id] for row in found if row.doc_id != 7) == sum(
        row.copies for row in found if row.taken and row.doc_id != 7
    )
    assert mix_sources(docs.limit(0)).count() == 0


FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return FOLDED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_benchmark_against_brute_force(documents, spark):
    items = [(i, words(2000 + i, 25, kinds=40)) for i in range(6)]
    items += [(6, "Two, WORDS"), (7, None), (8, " - "), (9, items[0][1]), (None, items[1][1]), (0, items[0][1])]
    texts = [(i, words(i, 30, kinds=40)) for i in range(20)]
    for i in range(6):
        texts.append((100 + i, "x" + texts[i][1] + " " + items[i][1].upper().replace(" ", ", ") + " " + texts[i][1]))
    texts += [(200, " ".join(items[2][1].split()[:10])), (201, " ".join(items[2][1].split()[:9])), (202, "two words é")]
    texts += [(900 + (name or 0), text) for name, text in ODD]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, covered long")
    docs = documents(*texts)
    found = find_benchmark(docs, benchmark)
    got = by_id(found, "n_words", "n_hit", "items")
    for name, text in texts:
        mine, hit, owners = folded(text), set(), set()
        for item, passage in items:
            theirs = folded(passage)
            size = min(10, len(theirs))
            for k in range(len(theirs) - size + 1) if size else []:
                for at in range(len(mine) - size + 1):
                    if mine[at : at + size] == theirs[k : k + size]:
                        hit |= set(range(at, at + size))
                        owners |= {str(item)} if item is not None else set()
        assert (len(mine), len(hit), sorted(owners)) in got[name]
    longest = max(m.n_words for row in found.where("doc_id = 100").collect() for m in row.matches)
    assert longest == 25
    kept = {row.doc_id for row in remove_contaminated(docs, benchmark).collect()}
    assert kept == {name for name, some in got.items() if some[0][1] == 0}
    assert find_benchmark(docs.limit(0), benchmark).count() == 0
    assert find_benchmark(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
