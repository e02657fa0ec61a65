"""Benchmark passages inside documents, found with suffix arrays over the documents."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice, utf8

# Lower-cases A-Z and turns every ASCII character outside 0-9 A-Z a-z into a space.
FOLD = bytes(
    code + 32 if 65 <= code <= 90 else code if code > 127 or chr(code).isalnum() else 32
    for code in range(256)
)
# Benchmark items are searched in blocks of at most so many bytes of text: a
# block goes to every task, so its size is bounded and checked.
BLOCK_BYTES = 32_000_000


def item_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Suffixes:
    """Suffix array over numbered words; 0 stands for a word that ends every match."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, depth: int):
        """Orders the suffixes at `starts` by their first `depth` words at least."""
        self.bytes = words.astype(">u4").tobytes()
        rank = words.astype(np.int64)
        width = 1
        # Prefix doubling: order by the first 1, 2, 4, ... words.
        while width < depth and len(rank):
            after = np.zeros(len(rank), np.int64)
            after[:-width] = rank[width:] if width < len(rank) else 0
            after[rank == 0] = 0
            order = np.lexsort((after, rank))
            pairs = np.stack([rank[order], after[order]])
            fresh = np.empty(len(rank), np.int64)
            fresh[order] = np.concatenate(
                [[1], 1 + np.cumsum(np.any(pairs[:, 1:] != pairs[:, :-1], axis=0))]
            )
            fresh[rank == 0] = 0
            rank, width = fresh, width * 2
        self.order = starts[np.argsort(rank[starts], kind="stable")]

    def key(self, at: int, n: int) -> bytes:
        return self.bytes[4 * at : 4 * (at + n)]

    def find(self, wanted: bytes) -> np.ndarray:
        """All positions at which the words of `wanted` stand."""
        n = len(wanted) // 4
        low = bisect_left(self.order, wanted, key=lambda at: self.key(at, n))
        high = bisect_right(self.order, wanted, low, key=lambda at: self.key(at, n))
        return self.order[low:high]

    def common(self, at: int, wanted: bytes) -> int:
        """Words that agree from position `at` on with `wanted`."""
        ours = np.frombuffer(self.key(at, len(wanted) // 4), ">u4")
        theirs = np.frombuffer(wanted, ">u4")[: len(ours)]
        differ = np.flatnonzero(ours != theirs)
        return int(differ[0]) if len(differ) else len(ours)


class Items:
    """A block of benchmark items as numbered words, with their windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        # A window's words -> the items it is in, each with its words from there on.
        self.windows: dict[bytes, list[tuple[str | None, bytes]]] = {}
        self.depth = self.shortest = window
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in item_words(text)]
            packed = np.array(ids, ">u4").tobytes()
            size = min(window, len(ids))
            if not size:
                continue
            self.shortest = min(self.shortest, size)
            for start in range(0, 4 * (len(ids) - size + 1), 4):
                key = packed[start : start + 4 * size]
                self.windows.setdefault(key, []).append((name, packed[start:]))


def runs_from(known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions followed by at least `least` known words, and where these end."""
    stops = np.append(np.flatnonzero(~known), len(known))
    at = np.flatnonzero(known)
    ends = stops[np.searchsorted(stops, at)]
    long = ends - at >= least
    return at[long], ends[long]


def search(texts: list[bytes], items: Items) -> list[dict]:
    """One suffix array over the texts; every window of every item is looked up in it."""
    get = items.number.get
    rows = [[get(word, 0) for word in item_words(text)] for text in texts]
    # A 0 follows each text, so that no match crosses into the next.
    offsets = np.cumsum([0] + [len(row) + 1 for row in rows])
    total = int(offsets[-1])
    flat = np.zeros(total, np.int64)
    for row, offset in zip(rows, offsets):
        flat[offset : offset + len(row)] = row
    matches: list[list] = [[] for _ in rows]
    cover = np.zeros(total + 1, np.int64)
    starts, ends = runs_from(flat != 0, items.shortest)
    if len(starts):
        # Only long enough stretches of known words can match; the rest is left out.
        mark = np.zeros(total + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, ends + 1, -1)
        place = np.flatnonzero(np.cumsum(mark)[:total] > 0)
        array = Suffixes(flat[place], np.searchsorted(place, starts), items.depth)
        text_at = np.searchsorted(offsets, place, side="right") - 1
        for key, owners in items.windows.items():
            for at in array.find(key).tolist():
                where, text = int(place[at]), int(text_at[at])
                cover[where] += 1
                cover[where + len(key) // 4] -= 1
                for name, rest in owners:
                    matches[text].append(
                        (where - int(offsets[text]), array.common(at, rest), name)
                    )
    covered = np.cumsum(cover)[:total] > 0
    return [
        {
            "n_words": len(row),
            "covered": np.flatnonzero(covered[offset : offset + len(row)]).tolist(),
            "matches": found,
        }
        for row, offset, found in zip(rows, offsets, matches)
    ]


MATCHES = "array<struct<start: long, n_words: long, item_id: string>>"


def _blocks(benchmark: DataFrame) -> list[list[tuple[str | None, bytes]]]:
    """The items in blocks of at most `BLOCK_BYTES`, read one after the other."""
    blocks, held = [[]], 0
    wanted = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    for name, text in wanted.toLocalIterator():
        raw = text.encode()
        if blocks[-1] and held + len(raw) > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append((name, raw))
        held += len(raw)
    return blocks


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each document, the words inside passages of benchmark items.

    A window is `window` consecutive words of an item; an item with fewer words,
    but not none, is one window. Words are runs of ASCII letters and digits and
    of all characters beyond ASCII, with A-Z as a-z. Each task builds a suffix
    array over a slice of the documents (a shard), in which the suffixes of all
    items are looked up by binary search. Nothing is shuffled. The items go to
    the tasks in blocks of bounded size; a large benchmark makes more passes.

    Returns `doc_id, n_words, n_hit, items, matches`: the sorted ids of items with
    occurring windows, and for each occurrence of a window its first word, the
    length of the longest verbatim match from there on, and the item.

    Null and empty texts have no words. Items without an id cover words but are
    not listed. Equal items are all listed. Repeated rows are judged each on its
    own, other columns are left out, and empty tables give no rows or no hits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        "text",
        F.array().cast("array<long>").alias("covered"),
        F.array().cast(MATCHES).alias("matches"),
    )
    blocks = _blocks(benchmark)
    for number, block in enumerate(blocks, 1):
        rows = _one_pass(rows, block, window, kind, keep_text=number < len(blocks))
    names = F.array_sort(F.array_distinct(F.filter("matches.item_id", lambda n: n.isNotNull())))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        names.alias("items"),
        "matches",
    )


def _one_pass(
    rows: DataFrame, block: list, window: int, kind: str, keep_text: bool
) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def work():
        items = Items(shared.value, window)

        def step(batch: pa.RecordBatch) -> dict:
            found = search(utf8(batch, 1), items)
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            covered, matches = [], []
            for one, (words, known) in zip(found, before):
                covered.append(sorted({*words, *one["covered"]}) if words else one["covered"])
                fresh = [
                    {"start": at, "n_words": n, "item_id": name}
                    for at, n, name in sorted(one["matches"], key=lambda m: (m[0], m[1], str(m[2])))
                ]
                matches.append(known + fresh)
            return {
                "doc_id": batch.column(0),
                "text": batch.column(1),
                "covered": covered,
                "matches": matches,
                "n_words": [one["n_words"] for one in found],
            }

        return step

    text = "text string, " if keep_text else ""
    schema = f"doc_id {kind}, {text}covered array<long>, matches {MATCHES}, n_words long"
    return per_slice(rows, "text", schema, work)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without any word inside a benchmark passage.

    All columns are kept. Rows with one id are judged together: if one of them
    is hit, all go. Rows with a null id count as one document in this.
    """
    hit = find_benchmark(docs, benchmark, window).where("n_hit > 0")
    gone = hit.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def item_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)
