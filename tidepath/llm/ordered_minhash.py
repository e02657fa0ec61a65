"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice, stored, utf8
from tidepath.llm.components import components
from tidepath.llm.substrings import LAST, WordHashes, gram_hashes, mix

# Words per shingle and the similarity from which documents are near-duplicates.
SHINGLE = 5
SIMILARITY = 0.8
# Sketches per document, and shingles in each. A pair with similarity 0.8 shares
# one sketch with probability about 0.8**6, so it misses all with about 2 in 10,000;
# a pair that has a third in common shares one with 1 in 30.
SKETCHES = 28
SAMPLE = 6
# Texts of up to so many shingles are found by their smallest ones, which loses no pair;
# their partners have up to a quarter more, so those have both kinds of keys.
SHORT = 16
# A document with very many partners is compared in groups of about so many.
PARTNERS = 500
# Where a document's partners are compared with each other, in groups of about so many bytes.
GROUP_BYTES = 8_000_000


def shingles(text: bytes, memo: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `k` words, in order; a shorter text is one shingle."""
    words = memo.of([word for word in text.split()])
    return gram_hashes(words, min(k, len(words)) or 1)


def label_occurrences(hashes: np.ndarray) -> np.ndarray:
    """Make repeats differ: each hash is joined with its number among its equals."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(fresh)
    number = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    labelled = np.empty_like(hashes)
    labelled[order] = mix(ranked + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return labelled


SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sketches(hashes: np.ndarray, many: int = SKETCHES, sample: int = SAMPLE) -> list[int]:
    """The keys that near-duplicates share.

    Order MinHash: per sketch the smallest labelled shingles, in the order of the text.
    For a short text, in whose place each sketch would hold nearly all of it, the keys
    are its smallest labelled shingles, one more than a similar text can lack.
    """
    if not len(hashes):
        return []
    labelled = label_occurrences(hashes)
    found = []
    if len(labelled) <= SHORT / SIMILARITY:
        spare = int(len(labelled) * (1 - SIMILARITY) + 1e-9)
        for value in np.sort(labelled)[: spare + 1]:
            found.append(xxhash.xxh3_64_intdigest(value.tobytes(), seed=many) - 2**63)
    if len(labelled) > SHORT:
        for number in range(many):
            value = labelled * SEEDS[number]  # the labels are mixed: an odd factor reorders them
            least = np.argpartition(value, sample - 1)[:sample]
            kept = labelled[np.sort(least)].tobytes()
            found.append(xxhash.xxh3_64_intdigest(kept, seed=number) - 2**63)
    return found


def aligned(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences by banded alignment, or 0 below `least`.

    It is matches / (len a + len b - matches), with the most matches that keep
    the order of both. `least` bounds the shingles without a match, so no match
    further than that off the diagonal counts: the band. In it, the longest
    common subsequence is the longest chain of rising places.
    """
    total = len(a) + len(b)
    if not a or not b:
        return 1.0 if a == b else 0.0
    if a == b:
        return 1.0
    needed = least * total / (1 + least)
    band = int(total - 2 * needed + 1e-9)
    if abs(len(a) - len(b)) > band:
        return 0.0
    if sum((Counter(a) & Counter(b)).values()) < needed - 1e-9:
        return 0.0
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for at in range(head, len(b) - tail):
        places[b[at]].append(at)
    ends: list[int] = []
    for at in range(head, len(a) - tail):
        for place in reversed(places.get(a[at], ())):
            if abs(place - at) <= band:
                spot = bisect_left(ends, place)
                ends[spot : spot + 1] = [place]
    matches = head + tail + len(ends)
    similarity = matches / (total - matches)
    return similarity if similarity >= least - 1e-12 else 0.0


def _sketched(rows: DataFrame) -> DataFrame:
    def work():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            texts = [text.split() for text in utf8(batch, 1)]
            return {
                "at": batch.column(0),
                "digest": [xxhash.xxh3_128_hexdigest(b" ".join(words)) for words in texts],
                "n_words": [len(words) for words in texts],
                "sketch": [sketches(gram_hashes(memo.of(w), min(SHINGLE, len(w)) or 1)) for w in texts],
            }

        return step

    return per_slice(rows, "text", "at long, digest string, n_words long, sketch array<long>", work)


def _beside_leads(
    texts: DataFrame, pairs: DataFrame, load: Column | None = None, most: int = PARTNERS
) -> DataFrame:
    """Rows `lead, part, turn, at, text, parts`: the texts of a lead, then those of its others.

    The others of a lead are sorted behind it in `parts` groups, each with a `load` (a
    whole number, 1 by default) of about `most`; a task keeps one lead's shingles at a time and reads
    the others one by one.
    """
    parts = F.ceil(F.sum(F.lit(1) if load is None else load) / most).cast("int")
    counts = pairs.groupBy("lead").agg(parts.alias("parts"))
    grouped = pairs.join(counts, "lead").select(
        "lead", "other", F.pmod(F.xxhash64("other"), "parts").cast("int").alias("part"), "parts"
    )
    leads = counts.select(
        "lead",
        F.col("lead").alias("at"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("turn"),
        "parts",
    )
    others = grouped.select(
        "lead", F.col("other").alias("at"), "part", F.lit(1).alias("turn"), "parts"
    )
    return (
        leads.unionByName(others)
        .join(texts, "at")
        .select("lead", "part", "turn", "at", "text", "parts")
        .repartition("lead", "part")
        .sortWithinPartitions("lead", "part", "turn", "text")
    )


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (`lead`, `other`) whose texts are similar enough, as `a, b`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        group, firsts = None, []
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in range(4))
            for (lead, part, turn, at), text in zip(zip(*columns), utf8(batch, 4)):
                some = shingles(text, memo).tolist()
                if group != (lead, part):
                    group, firsts = (lead, part), []
                if turn == 0:  # more than one text only if rows share the id
                    firsts.append(some)
                elif any(aligned(first, some) for first in firsts):
                    found.append((lead, at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return _beside_leads(texts, pairs).mapInArrow(run, "a long, b long")


def _held_twice(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists without what only one of them holds; none holds a value twice."""
    flat = np.concatenate(lists)
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    kept = often[which] > 1
    ends = np.cumsum([len(some) for some in lists])
    return np.split(flat[kept], np.concatenate([[0], np.cumsum(kept)])[ends[:-1]])


def _differences(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """How each `other` differs from its `lead`, by labelled shingles.

    `lead, at, n_lead, n` (shingles of both), `missing` (the lead's that it lacks),
    `n_extras` (how many of its own the lead lacks) and `extras` (which of these others of
    the lead may have too). Most extras are in one text only; where all others of a lead
    are in one group, those are left out here and need not be counted. Of rows that share
    the lead's id the text that sorts first stands for the lead.
    """
    names = ["lead", "at", "n_lead", "n", "missing", "n_extras", "extras"]
    types = [*[pa.int64()] * 2, *[pa.int32()] * 4, pa.list_(pa.int64())]
    sizes = texts.groupBy(F.col("at").alias("other")).agg(F.sum("size").alias("size"))

    def rows_of(held: list[tuple], parts: int) -> list[tuple]:
        lists = [extras for *_, extras in held]
        if held and parts == 1:
            lists = _held_twice(lists)
        return [(*row[:-1], len(row[-1]), some.tolist()) for row, some in zip(held, lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        group, first, held = (None, None, 1), np.empty(0, np.int64), []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)],
                names=names,
            )

        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5))
            for (lead, part, turn, at, parts), text in zip(zip(*columns), utf8(batch, 4)):
                some = np.unique(label_occurrences(shingles(text, memo)).view(np.int64))
                if group != (lead, part, parts):
                    found += rows_of(held, group[2])
                    group, first, held = (lead, part, parts), some, []
                if turn:
                    extras = np.setdiff1d(some, first, assume_unique=True)
                    missing = len(first) - (len(some) - len(extras))
                    held.append((lead, at, len(first), len(some), missing, extras))
            yield batch_of(found)
        yield batch_of(rows_of(held, group[2]))

    return _beside_leads(texts, pairs.join(sizes, "other"), F.col("size"), GROUP_BYTES).mapInArrow(
        run,
        "lead long, at long, n_lead int, n int, missing int, n_extras int, extras array<long>",
    )


def _strays(texts: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs `lead, other` of one lead's others, in different groups, that may be similar.

    Similar texts of a and b shingles have at least (a + b) x 0.8 / 1.8 in common. Of
    these, the lead's shingles less those that one of the two lacks can be the lead's;
    `need` is how many must then be extras of both. Where nothing is needed, the two
    are a pair; there both hold nearly as much of the lead as a similar text would. In
    all other cases each text's extras are sorted, rarest first, and two that share
    `need` of them share one among the first (all - need + 1). One of the two is in
    another group than the lead. So no similar pair is lost, and texts that each
    differ from the lead in their own way are not compared with each other.
    """
    share = SIMILARITY / (1 + SIMILARITY)
    of_lead = groups.select(F.col("node").alias("lead"), F.col("component").alias("_lead_in"))
    named = (
        pairs.join(groups.select(F.col("node").alias("other"), "component"), "other", "left")
        .join(of_lead, "lead", "left")
        .select(
            "lead",
            F.col("other").alias("at"),
            F.coalesce("component", "other").alias("component"),
            (F.coalesce("component", "other") != F.coalesce("_lead_in", "lead")).alias("out"),
        )
    )
    mixed = (
        named.groupBy("lead")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("lead")
    )
    named = stored(named.join(mixed, "lead"), "sketch-open")
    differ = stored(
        _differences(texts, named.select("lead", F.col("at").alias("other"))), "sketch-differences"
    )
    rows = differ.join(named, ["lead", "at"])
    outs = F.when(F.col("out"), share * F.col("n") + F.col("missing"))
    bounds = rows.groupBy("lead").agg(
        F.min("n").alias("n_least"), F.min(outs).alias("out_least")
    )
    # What a text needs of whichever partner: as one of another group than the lead, and as any.
    partner = F.greatest(F.col("n_least"), SIMILARITY * F.col("n"))
    as_out = share * (F.col("n") + partner) - F.col("n_lead") + F.col("missing")
    as_any = share * F.col("n") - F.col("n_lead") + F.col("out_least")
    at_least = lambda need: F.greatest(F.lit(1), F.ceil(need - 1e-9)).cast("int")
    rows = rows.join(bounds, "lead").select(
        "lead", "at", "component", "out", "n_lead", "n", "missing", "n_extras", "extras",
        F.xxhash64("extras").alias("row"),
        (as_out <= 1e-9).alias("free"),
        at_least(as_out).alias("need_out"),
        at_least(as_any).alias("need_any"),
    )
    need = (
        share * (F.col("x.n") + F.col("y.n"))
        - F.col("x.n_lead")
        + F.greatest("x.missing", "y.missing")
    )
    apart = F.col("x.component") != F.col("y.component")
    pair = (F.least("x.at", "y.at").alias("lead"), F.greatest("x.at", "y.at").alias("other"))

    thin = rows.drop("extras")
    free = (
        thin.where("out and free").alias("x")
        .join(thin.alias("y"), F.expr("x.lead = y.lead") & apart & (need <= 1e-9))
        .select(*pair)
    )
    each = rows.withColumn("extra", F.explode("extras")).drop("extras")
    shared = (
        each.groupBy("lead", "extra")
        .agg(
            F.count(F.lit(1)).alias("often"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .where("low <> high")
        .select("lead", "extra", "often")
    )
    kept = [c for c in rows.columns if c != "extras"]
    sorted_rows = (
        each.join(shared, ["lead", "extra"])
        .groupBy(*kept)
        .agg(F.array_sort(F.collect_list(F.struct("often", "extra"))).alias("extras"))
    )
    sorted_rows = stored(sorted_rows, "sketch-extras")
    first = lambda need: F.expr(
        f"slice(extras, 1, greatest(0, size(extras) - {need} + 1))"
    )
    prefixes = lambda df, need: df.withColumn("e", F.explode(first(need))).select(
        "lead", F.col("e.extra").alias("extra"), "at", "component", "n_lead", "n", "missing", "n_extras"
    )
    close = (
        prefixes(sorted_rows.where("out"), "need_out").alias("x")
        .join(
            prefixes(sorted_rows, "need_any").alias("y"),
            F.expr("x.lead = y.lead and x.extra = y.extra")
            & apart
            & (need <= F.least("x.n_extras", "y.n_extras") + 1e-9),
        )
        .select(*pair)
    )
    return free.unionByName(close).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, group_id, kept`: each row with the smallest id of its near-duplicates.

    Documents are linked whose sequences of five-word shingles are aligned with a
    similarity of at least 0.8 (see `aligned`); a text of fewer words is one
    shingle. Groups are what links connect. `kept` marks the first of a group.

    Texts with equal words are one text from here on. Texts that share an Order
    MinHash sketch, or short ones that share a small shingle, are candidates. In a
    bucket each text is first compared with its lead, the text that meets most others
    in all its buckets. Texts that stay in another group than the lead are compared
    with those of the bucket that differ from the lead in the same way (`_strays`). So
    a bucket of copies costs one comparison each, near copies that are not similar to
    each other cost few, and no candidate that could join two groups is left out.

    Null and empty texts are equal to nothing and stay alone. A null id counts as
    the last document; rows that share an id are one document, and link whatever
    any of them is similar to. An empty table gives an empty result.
    """
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at")
    rows = docs.select(at, "text")
    heads = stored(_sketched(rows), "sketches")
    firsts = (
        heads.where("n_words > 0").groupBy("digest").agg(F.min("at").alias("first"))
    )
    heads_of = heads.join(firsts, "digest").select("at", "first", "n_words", "sketch")
    copies = heads_of.where("at <> first").select(F.col("first").alias("a"), F.col("at").alias("b"))
    # Similar texts differ in shingles by a factor of 1 / 0.8 at most, so they are in
    # the same band of lengths or in neighbouring ones; each text is put in two.
    band = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(1 / SIMILARITY))).cast("long")
    buckets = (
        heads_of.where("at = first")
        .withColumn("n_shingles", F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1)))
        .select("at", band.alias("band"), F.explode("sketch").alias("sketched"))
        .select(
            "at",
            F.explode(
                F.array(
                    F.xxhash64("sketched", "band"), F.xxhash64("sketched", F.col("band") + 1)
                )
            ).alias("key"),
        )
        .distinct()
    )
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(buckets.join(sizes, "key"), "sketch-buckets")
    meets = members.groupBy("at").agg(F.sum("n").alias("meets"))
    leads = (
        members.select("key", "at")
        .join(meets, "at")
        .groupBy("key")
        .agg(F.max(F.struct("meets", (-F.col("at")).alias("back"))).alias("most"))
        .select("key", (-F.col("most.back")).alias("lead"))
    )
    pairs = stored(
        members.join(leads, "key")
        .where("at <> lead")
        .select("lead", F.col("at").alias("other"))
        .distinct(),
        "sketch-pairs",
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    texts = stored(rows.join(meets.select("at"), "at").withColumn("size", size), "sketch-texts")
    links = copies.unionByName(stored(_verify(texts, pairs), "sketch-links"))
    groups = components(links)
    # What is left: bucket mates that the first comparisons did not bring together.
    strays = stored(_strays(texts, pairs, groups), "sketch-strays")
    if not strays.isEmpty():
        more = stored(_verify(texts, strays), "sketch-links")
        if not more.isEmpty():
            groups = components(links.unionByName(more))
    kind = docs.schema["doc_id"].dataType
    named = heads.select("at").join(groups.withColumnRenamed("node", "at"), "at", "left")
    group = F.coalesce("component", "at")
    real = lambda c: F.when(c != LAST, c).cast(kind)
    return named.select(
        real(F.col("at")).alias("doc_id"),
        real(group).alias("group_id"),
        (group == F.col("at")).alias("kept"),
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are first of their near-duplicates, with all columns.

    Rows that share an id stay or go together.
    """
    groups = near_duplicates(docs)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
