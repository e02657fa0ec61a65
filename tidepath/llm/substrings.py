"""Passages that repeat across documents, found by windows of doubling length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice, stored, utf8

# A row without an id counts as the last document.
LAST = 2**63 - 1
EMPTY = hashlib.sha256(b"").hexdigest()
MEMO_WORDS = 400_000
# Words of more bytes are hashed one by one.
LONG_WORD = 64
LANE = np.array([2 ** (8 * size) - 1 for size in range(9)], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash, so that every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of `n` words, in their order."""
    many = max(0, len(words) - n + 1)
    total = np.zeros(many, np.uint64)
    for at in range(n):
        total = total * np.uint64(base) + words[at : at + many]
    return mix(total)


def window_keys(words: np.ndarray, n: int, window: int) -> np.ndarray:
    """For each window of `window` words the smallest hash of a run of `n` words in it.

    Equal windows have equal keys, and neighbours mostly share theirs, so that
    there are far fewer keys than windows. With `n = window` it is the window's hash.
    """
    grams = gram_hashes(words, n)
    many = max(0, len(words) - window + 1)
    least = grams[:many].copy()
    for at in range(1, window - n + 1):
        np.minimum(least, grams[at : at + many], out=least)
    return least


def levels_of(start: int, window: int) -> list[int]:
    """Lengths from `start` on, each twice the last, up to the window."""
    lengths = [min(start, window)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text; a text without any, or null, is one empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text begins.

    The begins have one more entry, the end of the last text. A word is hashed in lanes
    of 8 bytes, all words at once; of one lane, only words of different length can be equal.
    """
    lists = split_words(texts)
    words = lists.values
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1).astype(np.int64)
    data = (data.to_pybytes() if data else b"") + bytes(8)
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = ends[:-1], np.diff(ends)
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashes = mix(size.astype(np.uint64) * odd ^ lanes[start] & LANE[np.minimum(size, 8)])
    done, left = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(left):
        lane = lanes[start[left] + done] & LANE[np.minimum(size[left] - done, 8)]
        hashes[left] = mix(hashes[left] * odd + lane)
        done += 8
        left = left[size[left] > done]
    for at in np.flatnonzero(size > LONG_WORD):
        hashes[at] = xxhash.xxh3_64_intdigest(data[ends[at] : ends[at + 1]])
    real = size > 0
    begins = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()]
    return begins, hashes[real]


def windows_of(begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window within one text the number of that text, and its place in it."""
    many = np.maximum(np.diff(begins) - window + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)


def surviving(
    begins: np.ndarray, words: np.ndarray, window: int, passed: list[tuple[int, pa.ListArray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Those of `windows_of` whose keys of every length passed so far repeat."""
    text, place = windows_of(begins, window)
    for n, lists in passed:
        found = window_keys(words, n, window)[begins[text] + place]
        cuts = np.searchsorted(text, np.arange(len(begins)))
        edges = lists.offsets.to_numpy()
        wanted = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        alive = np.zeros(len(text), bool)
        for at in np.flatnonzero(np.diff(cuts)):
            one = slice(cuts[at], cuts[at + 1])
            alive[one] = np.isin(found[one], wanted[edges[at] : edges[at + 1]])
        text, place = text[alive], place[alive]
    return text, place


def _identified(docs: DataFrame) -> DataFrame:
    """`at` (the id, null last), `fp` (a hash of the text) and the text."""
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(at.alias("at"), F.xxhash64("text").alias("fp"), "text")


def _heads(rows: DataFrame) -> DataFrame:
    def work():
        def step(batch: pa.RecordBatch) -> dict:
            words = split_words(batch.column(2))
            joined = pc.binary_join(words, " ").cast(pa.binary()).to_pylist()
            counts = pc.list_value_length(words).to_numpy()
            return {
                "at": batch.column(0),
                "fp": batch.column(1),
                "n_words": np.where([len(some) > 0 for some in joined], counts, 0),
                "digest": [hashlib.sha256(some).hexdigest() for some in joined],
            }

        return step

    return per_slice(rows, "text", "at long, fp long, n_words long, digest string", work)


def _keys(rows: DataFrame, n: int, window: int, passed: list[tuple[int, str]]) -> DataFrame:
    """`at, fp, key`: the distinct keys of length `n` of the windows that survive."""
    lengths = [length for length, _ in passed]
    columns = [rows.columns.index(name) for _, name in passed]

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            begins, words = word_hashes(batch.column(2))
            known = [(length, batch.column(c)) for length, c in zip(lengths, columns)]
            text, place = surviving(begins, words, window, known)
            keys = window_keys(words, n, window)[begins[text] + place]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
            keys, text = keys[fresh], text[fresh]
            cuts = np.searchsorted(text, np.arange(len(begins)))
            found = [np.unique(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            text = np.repeat(np.arange(len(found)), [len(some) for some in found])
            return {
                "at": batch.column(0).take(pa.array(text)),
                "fp": batch.column(1).take(pa.array(text)),
                "key": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64),
            }

        return step

    return per_slice(rows, "text", "at long, fp long, key long", work)


def _repeated_keys(keys: DataFrame, name: str) -> DataFrame:
    """Per id the keys that another text has too, as the array `name`.

    Rows are sent by id and not by text, as neighbouring ids pack well. Texts that
    share an id get the keys of both, which at most lets more windows survive.
    """
    shared = (
        keys.groupBy("key")
        .agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("low <> high")
        .select("key")
    )
    found = keys.select("at", "key").join(shared, "key")
    return found.groupBy("at").agg(F.collect_set("key").alias(name))


def _windows(rows: DataFrame, window: int, passed: list[tuple[int, str]]) -> DataFrame:
    """`row, at, place, h1, h2`: each surviving window with 96 bits of hash."""
    columns = [rows.columns.index(name) for _, name in passed]

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            begins, words = word_hashes(batch.column(2))
            known = [(n, batch.column(c)) for (n, _), c in zip(passed, columns)]
            text, place = surviving(begins, words, window, known)
            spots = begins[text] + place
            second = gram_hashes(words, window, base=0xD6E8FEB86659FD93)[spots]
            return {
                "row": batch.column(1).take(pa.array(text)),
                "at": batch.column(0).take(pa.array(text)),
                "place": place.astype(np.int32),
                "h1": gram_hashes(words, window)[spots].view(np.int64),
                "h2": (second >> np.uint64(32)).astype(np.uint32).view(np.int32),
            }

        return step

    return per_slice(rows, "text", "row long, at long, place int, h1 long, h2 int", work)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """`at, fp, spans, n_removed, kept`: the texts without the words of the given windows."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            spans, removed, kept = [], [], []
            for text, places in zip(utf8(batch, 2), batch.column(3).to_pylist()):
                words = text.split()
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, places, 1)
                np.add.at(mark, np.array(places) + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, drop in zip(words, gone.tolist()) if not drop]))
            return {
                "at": batch.column(0),
                "fp": batch.column(1),
                "spans": spans,
                "n_removed": removed,
                "kept": [text.decode() for text in kept],
            }

        return step

    schema = (
        "at long, fp long, spans array<struct<start: long, end: long>>, n_removed long, kept string"
    )
    return per_slice(rows, "text", schema, work)


def repeated_words(docs: DataFrame, window: int = 13, start: int = 7) -> tuple[DataFrame, DataFrame]:
    """Find the words inside windows that also start in a document with a smaller id.

    Words are runs of other characters than ASCII white space. Levels go from
    `start` words to twice that, and so on up to `window`: a window survives a
    level if its key of that length (see `window_keys`) is found in another text,
    and only texts with survivors are read again at the next. At the last level
    the windows themselves are compared, by 96 bits of hash. Windows are judged
    on the input.

    Texts with the same words as an earlier one need no windows: all their words
    go if there are at least `window`. Returns two tables: `heads` with a row per
    row of `docs` (`at, fp, n_words, digest, copy`), and `cut` with a row per other
    text that loses words (`at, fp, spans, n_removed, kept`); `at` is the id and
    `fp` a hash of the text.

    Null and empty texts have no words. A null id counts as the last document.
    Rows that share an id are one document: a window in both is no repeat.
    Tables without rows, or without repeats, give no cuts.
    """
    rows = _identified(docs)
    heads = stored(_heads(rows), "repeats-heads", tidy=True)
    originals = (
        heads.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("at").alias("first"))
    )
    heads = heads.join(originals, "digest", "left").select(
        "at", "fp", "n_words", "digest", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("copy")
    )
    alone = heads.where(~F.col("copy")).select("at", "fp").distinct()

    levels = levels_of(start, window)[:-1]
    passed: list[tuple[int, str]] = []
    texts = rows
    for number, n in enumerate(levels or [window]):
        name = f"keys{number}"
        found = _repeated_keys(_keys(texts, n, window, passed), name)
        if number == 0:
            # The small tables are joined first, so that the texts are shuffled once.
            texts = texts.join(alone.join(found, "at"), ["at", "fp"])
        else:
            texts = texts.join(found, "at")
        passed.append((n, name))
        texts = stored(
            texts.select("at", "fp", "text", *(c for _, c in passed)).withColumn(
                "row", F.monotonically_increasing_id()
            ),
            "repeats-texts",
            tidy=True,
        )

    by_row = texts.select("at", "row", "text", *(name for _, name in passed))
    windows = _windows(by_row, window, passed)
    earliest = (
        windows.groupBy("h1", "h2")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"))
        .where("low < high")
        .select("h1", "h2", "low")
    )
    later = (
        windows.join(earliest, ["h1", "h2"])
        .where("at > low")
        .groupBy("row")
        .agg(F.collect_set("place").alias("places"))
    )
    losing = texts.join(later, "row").select("at", "fp", "text", "places")
    return heads, _cut(losing, window)


def remove_repeats(docs: DataFrame, window: int = 13, start: int = 7) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` for every row of `docs`; see `repeated_words`."""
    heads, cut = repeated_words(docs, window, start)
    cut = cut.select("at", "fp", "n_removed", F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(
        ["at", "fp"]
    )
    kind = docs.schema["doc_id"].dataType
    doc_id = F.when(F.col("at") != LAST, F.col("at")).cast(kind)
    return heads.join(cut, ["at", "fp"], "left").select(
        doc_id.alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words"))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long")
        .alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY))
        .otherwise(F.coalesce("kept_sha", "digest"))
        .alias("kept_sha256"),
    )
