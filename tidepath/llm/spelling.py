"""Spelling variants: words one edit apart, found along a sorted vocabulary."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice, stored, utf8

# Shorter words, and words seen less often, are left out.
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form is at least so many times as frequent as the word it stands for.
TIMES = 10
# Words of the sorted vocabulary that a task holds at a time.
SHARD_WORDS = 20_000
# Counts grow by ten from word to form, so 64 bits allow 18 steps; following forms
# doubles the steps each time.
DOUBLINGS = 5
LAST = "\U0010ffff"


def count_words(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """`word, n`: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least seven code
    points, A-Z lower-cased, and how often they occur in all texts.

    With `damage`, a run loses a code point if that number divides the crc32 h of
    `doc_id:run`: the one at h modulo its length; what is then too short is left out. A
    null text has no words, a null id is the empty text. Texts are counted in slices,
    and the sums of a slice go into the shuffle.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            total: Counter[str] = Counter()
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch, 1)):
                found = Counter(pattern.findall(text.lower().decode(errors="replace")))
                if damage is None:
                    total.update(found)
                    continue
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    total[run] += n
            return {"word": list(total), "n": list(total.values())}

        return step

    texts = docs.select(F.col("doc_id").cast("string").alias("name"), "text").where("text is not null")
    counts = per_slice(texts, "text", "word string, n long", work)
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _lcp(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def shared_prefixes(words: list[str]) -> list[int]:
    """How many code points each word shares with the one before it."""
    return [0, *(_lcp(a, b) for a, b in zip(words, words[1:]))] if words else []


def one_edit(words: list[str], lcps: list[int], query: str, same: int) -> Iterator[int]:
    """Places in the sorted `words` of those one edit from `query` that share its first `same` code points.

    A row of the edit matrix belongs to a prefix of a word; of it, only the three cells
    around the diagonal can be 0 or 1. Rows are kept along the current word, and the next
    word goes on from the row of the prefix they share. Where all three cells are above
    1, so is every word with that prefix, and the scan goes on behind them.
    """
    m = len(query)
    prefix = query[:same]
    at, end = bisect_left(words, prefix), bisect_right(words, prefix + LAST)
    rows: list[tuple[int, int, int]] = [(2, 2, 2)] * (m + 3)
    rows[same] = (1, 0, 1)
    known = same
    while at < end:
        word = words[at]
        length = len(word)
        depth = known
        a, b, c = rows[depth]
        while depth < length and depth <= m and (a < 2 or b < 2 or c < 2):
            letter = word[depth]
            left = min(a + (query[depth - 1] != letter), b + 1) if depth else 2
            on = min(b + (query[depth] != letter), c + 1, left + 1) if depth < m else 2
            right = min(c + (query[depth + 1] != letter), on + 1) if depth + 1 < m else 2
            depth += 1
            a, b, c = rows[depth] = (left, on, right)
        if a > 1 and b > 1 and c > 1:
            at = bisect_right(words, word[:depth] + LAST, at + 1, end)
        else:
            if depth == length and abs(m - length) <= 1 and (a, b, c)[m - length + 1] == 1:
                yield at
            at += 1
        if at < end:
            known = max(same, min(lcps[at], depth))


def near_words(words: DataFrame) -> DataFrame:
    """`word, n_near, best_n, best_word` of every word that has others one edit away.

    One edit leaves either the first half of a word as it is, or the rest from there. So
    each word looks among the words with the same first half, and, with both reversed,
    among those with the same end. The vocabulary and its reverse are range-partitioned
    into sorted shards of about `SHARD_WORDS`; a word is sent to the shards that its half
    can be in, found from the shards' first words, of which the driver holds one each.
    """
    spark = words.sparkSession
    many = words.count()
    n_shards = max(1, -(-2 * many // SHARD_WORDS))
    both = words.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("word").alias("key")),
                F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")),
            )
        ).alias("entry"),
        "n",
    ).select("entry.*", "n")
    shards = stored(
        both.repartitionByRange(n_shards, "side", "key").select(
            F.spark_partition_id().cast("long").alias("shard"), "side", "key", "n"
        ),
        "vocabulary",
    )
    firsts = sorted(
        (row.first.side, row.first.key, row.shard)
        for row in shards.groupBy("shard").agg(F.min(F.struct("side", "key")).alias("first")).collect()
    )
    starts, numbers = [f[:2] for f in firsts], [f[2] for f in firsts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for side, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                half = len(key) // 2
                half = len(key) - half if side else half
                low = max(bisect_right(starts, (side, key[:half])) - 1, 0)
                high = bisect_right(starts, (side, key[:half] + LAST))
                out += [(number, side, key, half) for number in numbers[low:high]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))],
                names=["shard", "side", "key", "half"],
            )

    queries = shards.select("side", "key").mapInArrow(route, "shard long, side int, key string, half int")
    lists = shards.select("shard", "side", "key", F.lit(0).alias("half"), "n")
    dealt = (
        lists.unionByName(queries.withColumn("n", F.lit(None).cast("long")))
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", F.asc_nulls_last(F.col("n").isNull()), "side", "key")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        lists: dict[int, tuple[list[str], list[int]]] = {}
        lcps: dict[int, list[int]] = {}
        for batch in batches:
            out = []
            names = ("shard", "side", "key", "half", "n")
            for shard, side, key, half, n in zip(*(batch.column(c).to_pylist() for c in names)):
                if shard != now:
                    now, lists, lcps = shard, {0: ([], []), 1: ([], [])}, {}
                if n is not None:
                    lists[side][0].append(key)
                    lists[side][1].append(n)
                    continue
                words, counts = lists[side]
                if side not in lcps:
                    lcps[side] = shared_prefixes(words)
                # What shares the first half as well was found on the other side.
                near = [
                    (-counts[at], words[at][::-1] if side else words[at])
                    for at in one_edit(words, lcps[side], key, half)
                    if not (side and words[at].endswith(key[half:]))
                ]
                if near:
                    best = min(near)
                    out.append((key[::-1] if side else key, len(near), -best[0], best[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "n_near", "best_n", "best_word"],
            )

    found = dealt.mapInArrow(scan, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best_word"))
    )


def spelling_variants(counts: DataFrame) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for words of `counts` (`word, n`) seen twice or more.

    Two words are near if one inserted, deleted or replaced code point makes one of the
    other. A word's form is its most frequent near word (ties: first by code point), if
    that is ten times as frequent; `form_n` is the form's count. `root` is where the
    forms lead in the end, the word itself without one. Null words and words below
    seven code points are left out; rows of the same word are added up. An empty table
    gives an empty result.
    """
    summed = counts.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(summed.where(F.col("n") >= LEAST_COUNT), "words")
    near = near_words(words)
    has_form = F.col("best_n") >= TIMES * F.col("n")
    named = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("best_word")).alias("form"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = named.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(
            roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"
        )
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
