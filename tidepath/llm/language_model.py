"""Scores of texts under a hierarchical Pitman-Yor language model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import slices, stored, utf8
from tidepath.llm.substrings import WordHashes, mix

# Lower-cases A-Z.
FOLD = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))
# The token after the last word; no word holds a space.
END = b" "
# Texts are numbered in chunks of about so many bytes, and words are dealt out to
# buckets so that each gets about so many (context, word) cells of all chunks.
CHUNK_BYTES = 8_000_000
BUCKET_CELLS = 1_500_000
# A context is named by the high bits of its word's hash; in a bucket it has a number.
CONTEXT_SHIFT = np.uint64(16)
LOW = (1 << 32) - 1
# Sweeps of the sampler, and how many of the last ones are averaged.
SWEEPS = 4
AVERAGED = 2
STRENGTH = 1.0
# A cell's first customers are seated one by one, the others in steps of a
# sixteenth of those that are seated.
ONE_BY_ONE = 64


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all first, as high bytes pack well alone."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of large values as dictionaries, of which one at a time is made."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of texts: ids, whether held out, lengths, word hashes and tokens."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = rows.sparkSession.createDataFrame([], f"doc_id {kind}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_id = to_arrow_schema(id_type).field(0).type
        memo, done = WordHashes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, 2, CHUNK_BYTES):
                hashes, lengths = [], []
                for text in utf8(some, 2):
                    words = text.translate(FOLD).split()
                    words.append(END)
                    hashes.append(memo.of(words))
                    lengths.append(len(words))
                # Distinct words once, and their numbers for the tokens.
                distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
                made = {
                    "chunk": [(part << 32) + done],
                    "ids": pa.array([some.column(0).to_pylist()], pa.list_(arrow_id)),
                    "held": [some.column(1).to_pylist()],
                    "lengths": [lengths],
                    "words": [pack(distinct)],
                    "tokens": [pack(number.astype(np.uint32))],
                }
                done += 1
                yield pa.RecordBatch.from_pydict(made)

    schema = (
        f"chunk long, ids array<{kind}>, held array<boolean>, lengths array<int>, "
        "words binary, tokens binary"
    )
    return rows.mapInArrow(_typed(run, schema, rows), schema)


def _typed(run, schema: str, like: DataFrame):
    """Cast what `run` yields to `schema`, so that it can build columns from plain lists."""
    wanted = like.sparkSession.createDataFrame([], schema).schema

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        for batch in run(batches):
            columns = [batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return typed


def _read_chunk(lengths: list[int], words: bytes, tokens: bytes) -> tuple:
    """The chunk's word hashes, cell keys, cell of each token, and where texts start.

    A cell key is the word's number and, in its low 32 bits, the context: one more than
    the number of the whole word before, or 0 for the first token of a text.
    """
    hashes = unpack(words, np.uint64)
    number = unpack(tokens, np.uint32).astype(np.int64)
    starts = np.cumsum(lengths) - np.array(lengths)
    context = np.zeros(len(number), np.int64)
    context[1:] = number[:-1] + 1
    context[starts] = 0
    keys, cell = np.unique(number << 32 | context, return_inverse=True)
    return hashes, keys, cell, starts


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket its words, its cells of them, and how often each was trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                hashes, keys, cell, _ = _read_chunk(*(row[c] for c in ("lengths", "words", "tokens")))
                train = np.repeat(~np.array(row["held"], bool), row["lengths"])
                trained = np.bincount(cell[train], minlength=len(keys))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                word, context = keys >> 32, keys & LOW
                # Hashes are sorted, so contexts are in the order of their numbers.
                names_of = np.append(np.uint64(0), hashes >> CONTEXT_SHIFT)
                of_cell = bucket[word]
                order, word_order = np.argsort(of_cell, kind="stable"), np.argsort(bucket, kind="stable")
                at = np.searchsorted(of_cell[order], np.arange(buckets + 1))
                word_at = np.searchsorted(bucket[word_order], np.arange(buckets + 1))
                made = []
                for b in np.flatnonzero(np.diff(word_at)).tolist():
                    cells = order[at[b] : at[b + 1]]
                    names = word_order[word_at[b] : word_at[b + 1]]
                    used, which = np.unique(context[cells], return_inverse=True)
                    made.append(
                        {
                            "chunk": row["chunk"],
                            "bucket": b,
                            "words": pack(hashes[names]),
                            "held": pack(
                                np.bincount(
                                    np.searchsorted(names, word[cells]), minlength=len(names)
                                ).astype(np.uint32)
                            ),
                            "contexts": pack(np.diff(names_of[used], prepend=np.uint64(0))),
                            "which": pack(which.astype(np.uint32)),
                            "trained": pack(trained[cells].astype(np.uint32)),
                        }
                    )
                if made:
                    yield pa.RecordBatch.from_pylist(made)

    schema = (
        "chunk long, bucket int, words binary, held binary, contexts binary, which binary, "
        "trained binary"
    )
    return chunks.mapInArrow(_typed(run, schema, chunks), schema)


@dataclass
class Cells:
    """A bucket's cells, ordered by word and context, with their training counts."""

    words: np.ndarray
    contexts: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    word: np.ndarray = field(init=False)
    context: np.ndarray = field(init=False)

    def __post_init__(self):
        self.word, self.context = self.keys >> 32, self.keys & LOW
        self.word_counts = np.bincount(self.word, self.counts, len(self.words)).astype(np.int64)


def _merge(requests: DataFrame) -> DataFrame:
    """One row per bucket: its cells with summed counts, and where each chunk's cells are in it."""

    def merged(bucket: int, parts: list[dict]) -> dict:
        words = np.unique(np.concatenate([unpack(p["words"], np.uint64) for p in parts]))
        named = [np.cumsum(unpack(p["contexts"], np.uint64)) for p in parts]
        contexts = np.unique(np.concatenate(named))
        keys, counts = [], []
        for part, names in zip(parts, named):
            number = np.searchsorted(words, unpack(part["words"], np.uint64))
            held = unpack(part["held"], np.uint32)
            context = np.searchsorted(contexts, names)[unpack(part["which"], np.uint32)]
            keys.append(np.repeat(number, held).astype(np.int64) << 32 | context)
            counts.append(unpack(part["trained"], np.uint32))
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return {
            "bucket": bucket,
            "words": pack(words),
            "contexts": pack(np.diff(contexts, prepend=np.uint64(0))),
            "keys": pack(np.diff(distinct, prepend=0)),
            "counts": pack(total),
            "chunks": [p["chunk"] for p in parts],
            # Steps from cell to cell pack better than places.
            "places": [
                pack(np.diff(at, prepend=0).astype(np.uint32)) for at in np.split(place, cuts)
            ],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for row in one_by_one(batch):
                if row["bucket"] != bucket:
                    if parts:
                        yield pa.RecordBatch.from_pylist([merged(bucket, parts)])
                    bucket, parts = row["bucket"], []
                parts.append(row)
        if parts:
            yield pa.RecordBatch.from_pylist([merged(bucket, parts)])

    schema = (
        "bucket int, words binary, contexts binary, keys binary, counts binary, "
        "chunks array<long>, places array<binary>"
    )
    dealt = requests.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_typed(run, schema, requests), schema)


@dataclass
class Totals:
    """What one sweep needs of all buckets: sums at the root, and per context of one bucket."""

    customers: np.ndarray  # per context of the bucket
    tables: np.ndarray  # per context of the bucket
    root_customers: float
    root_tables: float


@dataclass
class Settings:
    discount: float  # of the contexts
    root_discount: float
    tokens: int  # N
    types: int  # V


def seat(counts: np.ndarray, fresh: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables that `counts` customers take, cell by cell.

    Each customer of a dish joins one of its tables with weight (seated customers
    - discount x tables), or opens one with weight `fresh`.
    """
    order = np.argsort(-counts, kind="stable")
    many, weight = counts[order].astype(np.int64), fresh[order]
    tables = (many > 0).astype(np.float64)
    rising = -many
    seated = 1
    while True:
        alive = int(np.searchsorted(rising, -seated, side="left"))  # counts above `seated`
        if not alive:
            break
        step = 1 if seated < ONE_BY_ONE else seated // 16
        now = weight[:alive]
        chance = now / (now + seated - discount * tables[:alive])
        if step == 1:
            tables[:alive] += rng.random(alive) < chance
        else:
            tables[:alive] += rng.binomial(np.minimum(step, many[:alive] - seated), chance)
        seated += step
    found = np.empty_like(tables)
    found[order] = tables
    return found


class Restaurants:
    """The seating of a bucket: a restaurant per context, and the root they share."""

    def __init__(self, cells: Cells, settings: Settings, seed: int):
        self.cells, self.settings = cells, settings
        self.rng = np.random.default_rng(seed)
        self.tables = (cells.counts > 0).astype(np.float64)
        self.customers = np.bincount(cells.word, self.tables, len(cells.words))
        self.root_tables = (self.customers > 0).astype(np.float64)

    def totals(self) -> Totals:
        """The sums over this bucket alone."""
        context, many = self.cells.context, len(self.cells.contexts)
        return Totals(
            np.bincount(context, self.cells.counts, many),
            np.bincount(context, self.tables, many),
            float(self.customers.sum()),
            float(self.root_tables.sum()),
        )

    def root(self, totals: Totals) -> np.ndarray:
        """Probability of each word at the root; words not trained on share one type."""
        s = self.settings
        base = (STRENGTH + s.root_discount * totals.root_tables) / (s.types + 1)
        own = self.customers - s.root_discount * self.root_tables
        return (own + base) / (STRENGTH + totals.root_customers)

    def sweep(self, totals: Totals) -> None:
        """Seat every cell again, given the sums after the last sweep and the root's words."""
        s, cells = self.settings, self.cells
        root = self.root(totals)
        fresh = (STRENGTH + s.discount * totals.tables[cells.context]) * root[cells.word]
        self.tables = seat(cells.counts, fresh, s.discount, self.rng)
        self.customers = np.bincount(cells.word, self.tables, len(cells.words))
        base = (STRENGTH + s.root_discount * totals.root_tables) / (s.types + 1)
        self.root_tables = seat(
            self.customers, np.full(len(self.customers), base), s.root_discount, self.rng
        )

    def predict(self, totals: Totals) -> np.ndarray:
        s, cells = self.settings, self.cells
        back = (STRENGTH + s.discount * totals.tables[cells.context]) * self.root(totals)[cells.word]
        own = cells.counts - s.discount * self.tables
        return (own + back) / (STRENGTH + totals.customers[cells.context])


def _cells_in(row: dict) -> Cells:
    return Cells(
        unpack(row["words"], np.uint64),
        np.cumsum(unpack(row["contexts"], np.uint64)),
        np.cumsum(unpack(row["keys"], np.int64)),
        unpack(row["counts"], np.uint64).astype(np.int64),
    )


def _settings(buckets: DataFrame) -> Settings:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                cells = _cells_in(row)
                kinds = np.bincount(cells.word, cells.counts > 0, len(cells.words))
                numbers = [
                    (cells.counts == 1).sum(), (cells.counts == 2).sum(),
                    (kinds == 1).sum(), (kinds == 2).sum(),
                    cells.counts.sum(), (cells.word_counts > 0).sum(),
                ]
                yield pa.RecordBatch.from_pydict({f"s{i}": [int(x)] for i, x in enumerate(numbers)})

    schema = ", ".join(f"s{i} long" for i in range(6))
    sums = buckets.mapInArrow(_typed(run, schema, buckets), schema).agg(
        *(F.coalesce(F.sum(f"s{i}"), F.lit(0)) for i in range(6))
    ).first()
    # Share of mass that counts of one and two suggest to take off each table.
    share = lambda one, two: min(0.95, max(0.05, one / max(1, one + 2 * two)))
    return Settings(share(sums[0], sums[1]), share(sums[2], sums[3]), sums[4], sums[5])


class Owners:
    """Which bucket sums each of a bucket's contexts, and the contexts in that order."""

    def __init__(self, contexts: np.ndarray, buckets: int):
        owner = (mix(contexts) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(owner, kind="stable")
        self.at = np.searchsorted(owner[self.order], np.arange(buckets + 1))
        self.used = np.flatnonzero(np.diff(self.at)).tolist()

    def of(self, owner: int) -> np.ndarray:
        return self.order[self.at[owner] : self.at[owner + 1]]


def _history(cells: Cells, sums: pa.Table, roots: list[tuple], owners: Owners) -> list[Totals]:
    """The sums after each sweep so far, as the owners of the bucket's contexts returned them."""
    many = len(cells.contexts)
    customers, tables = np.zeros(many), np.zeros((len(roots), many))
    for batch in sums.to_batches():
        for row in one_by_one(batch):
            mine = owners.of(row["owner"])
            if row["sweep"] == 0:
                customers[mine] = unpack(row["customers"], np.uint64)
            tables[row["sweep"]][mine] = unpack(row["tables"], np.uint64)
    return [Totals(customers, now, *root) for now, root in zip(tables, roots)]


SUMS = "bucket int, owner int, sweep int, places binary, customers binary, tables binary"


def _after(
    cells: DataFrame, sums: DataFrame, settings: Settings, roots: list[tuple], buckets: int
) -> tuple[DataFrame, tuple]:
    """What all buckets have after the sweeps in `sums` and one that used the last of them.

    Per bucket and owner of contexts the sums over all buckets, in the order in which the
    bucket has them, and the sums at the root. An owner numbers its contexts the first
    time, and later sums come by these numbers (`places`).
    """
    sweep = len(roots)

    def send(mine: pa.Table, found: pa.Table) -> pa.Table:
        made = {name: [] for name in ("bucket", "owner", "names", "places", "customers", "tables")}
        for batch in mine.to_batches():
            for row in one_by_one(batch):
                held = _cells_in(row)
                owners = Owners(held.contexts, buckets)
                seating = Restaurants(held, settings, seed=row["bucket"])
                for totals in _history(held, found, roots, owners):
                    seating.sweep(totals)
                now = seating.totals()
                places = {}
                for batch in found.to_batches() if sweep else ():
                    for old in one_by_one(batch):
                        if old["sweep"] == 0:
                            places[old["owner"]] = old["places"]
                for owner in owners.used:
                    at = owners.of(owner)
                    made["bucket"].append(row["bucket"])
                    made["owner"].append(owner)
                    made["names"].append(
                        None if sweep else pack(np.diff(held.contexts[at], prepend=np.uint64(0)))
                    )
                    made["places"].append(places.get(owner))
                    made["customers"].append(None if sweep else pack(now.customers[at].astype(np.uint64)))
                    made["tables"].append(pack(now.tables[at].astype(np.uint64)))
                made["bucket"].append(row["bucket"])
                made["owner"].append(-1)
                for name in ("names", "places"):
                    made[name].append(None)
                made["customers"].append(pack(np.array([now.root_customers]).astype(np.uint64)))
                made["tables"].append(pack(np.array([now.root_tables]).astype(np.uint64)))
        return pa.table(
            [
                pa.array(made["bucket"], pa.int32()), pa.array(made["owner"], pa.int32()),
                *(pa.array(made[n], pa.binary()) for n in ("names", "places", "customers", "tables")),
            ],
            names=list(made),
        )

    def add(parts: pa.Table) -> pa.Table:
        rows = [row for batch in parts.to_batches() for row in one_by_one(batch)]
        owner = rows[0]["owner"]
        if owner < 0:
            places = [np.zeros(1, np.int64) for _ in rows]
        elif sweep:
            places = [np.cumsum(unpack(row["places"], np.uint32), dtype=np.int64) for row in rows]
        else:
            named = [np.cumsum(unpack(row["names"], np.uint64)) for row in rows]
            known = np.unique(np.concatenate(named))
            places = [np.searchsorted(known, names) for names in named]
        size = 1 + max(int(at[-1]) for at in places)

        def added(name: str) -> list[bytes | None]:
            if rows[0][name] is None:
                return [None for _ in rows]
            total = np.zeros(size, np.uint64)
            for row, at in zip(rows, places):
                total[at] += unpack(row[name], np.uint64)
            return [pack(total[at]) for at in (places[:1] if owner < 0 else places)]

        first = owner < 0
        some = rows[:1] if first else rows
        kept = [
            None if sweep or first else pack(np.diff(at, prepend=0).astype(np.uint32))
            for at in places[: len(some)]
        ]
        return pa.table(
            [
                pa.array([row["bucket"] for row in some], pa.int32()),
                pa.array([owner] * len(some), pa.int32()),
                pa.array([sweep] * len(some), pa.int32()),
                pa.array(kept, pa.binary()),
                pa.array(added("customers"), pa.binary()),
                pa.array(added("tables"), pa.binary()),
            ],
            names=["bucket", "owner", "sweep", "places", "customers", "tables"],
        )

    sent = cells.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(
        send, "bucket int, owner int, names binary, places binary, customers binary, tables binary"
    )
    found = stored(sent.groupBy("owner").applyInArrow(add, SUMS), "lm-sums")
    root = found.where("owner < 0").select("customers", "tables").first()
    root = tuple(float(unpack(x, np.uint64)[0]) for x in root) if root else (0.0, 0.0)
    return found.where("owner >= 0"), root


def _answers(
    merged: DataFrame, sums: DataFrame, settings: Settings, roots: list[tuple], buckets: int
) -> DataFrame:
    """Per chunk and bucket the log10 probability of each cell and the count of each word."""

    def answer(mine: pa.Table, found: pa.Table) -> pa.Table:
        made = {name: [] for name in ("chunk", "bucket", "logs", "seen")}
        for batch in mine.to_batches():
            for row in one_by_one(batch):
                cells = _cells_in(row)
                history = _history(cells, found, roots, Owners(cells.contexts, buckets))
                seating = Restaurants(cells, settings, seed=row["bucket"])
                mean = np.zeros(len(cells.keys))
                for number, totals in enumerate(history[:-1], 1):
                    seating.sweep(totals)
                    if number > len(history) - 1 - AVERAGED:
                        mean += seating.predict(history[number])
                logs = np.log10(mean / min(AVERAGED, len(history) - 1)).astype(np.float32)
                for chunk, steps in zip(row["chunks"], row["places"]):
                    place = np.cumsum(unpack(steps, np.uint32), dtype=np.int64)
                    words = np.unique(cells.word[place])
                    made["chunk"].append(chunk)
                    made["bucket"].append(row["bucket"])
                    made["logs"].append(pack(logs[place]))
                    made["seen"].append(pack(cells.word_counts[words].astype(np.uint64)))
        return pa.table(
            [
                pa.array(made["chunk"], pa.int64()), pa.array(made["bucket"], pa.int32()),
                pa.array(made["logs"], pa.binary()), pa.array(made["seen"], pa.binary()),
            ],
            names=list(made),
        )

    return merged.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(
        answer, "chunk long, bucket int, logs binary, seen binary"
    )


def _score(chunks: DataFrame, answers: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """Bring each chunk's answers back to it and sum them up by text."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    parts = ("ids", "held", "lengths", "words", "tokens")
    first = chunks.withColumn("bucket", F.lit(-1))
    both = first.unionByName(answers, allowMissingColumns=True).select(
        "chunk", "bucket", *parts, "logs", "seen"
    )
    total = settings.tokens + settings.types + 1

    def finish(row: dict, found: dict[int, tuple[bytes, bytes]]) -> dict:
        hashes, keys, cell, starts = _read_chunk(*(row[c] for c in parts[2:]))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        of_cell = bucket[keys >> 32]
        logs, seen = np.zeros(len(keys)), np.zeros(len(hashes))
        for number, (some_logs, some_seen) in found.items():
            logs[of_cell == number] = unpack(some_logs, np.float32)
            seen[bucket == number] = unpack(some_seen, np.uint64)
        seen = seen[unpack(row["tokens"], np.uint32)]
        return {
            "doc_id": row["ids"],
            "held_out": row["held"],
            "n_tokens": row["lengths"],
            "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts).tolist(),
            "base_score": np.add.reduceat(np.log10((seen + 1) / total), starts).tolist(),
            "score": np.add.reduceat(logs[cell], starts).tolist(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, found = None, {}
        for batch in batches:
            for one in one_by_one(batch):
                if one["bucket"] < 0:
                    if row:
                        yield pa.RecordBatch.from_pydict(finish(row, found))
                    row, found = one, {}
                else:
                    found[one["bucket"]] = (one["logs"], one["seen"])
        if row:
            yield pa.RecordBatch.from_pydict(finish(row, found))

    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double"
    )
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return dealt.mapInArrow(_typed(run, schema, chunks), schema)


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Log10 probability of every text under a model of the rows that are not held out.

    Tokens are runs of other characters than ASCII white space, with A-Z in lower
    case, and one end per text. The whole word before is the context of a token (by 48
    bits of hash); each context is a restaurant whose dishes are words, and all share
    one root over the words, itself over equal chances for the V words seen in
    training and one for all others. The seating is sampled by blocked Gibbs
    sweeps: all customers of a word in a context are seated again, given the
    other words' tables after the last sweep. The probabilities after the last
    `AVERAGED` of `SWEEPS` sweeps are averaged.

    Counts of all rows are kept: texts are numbered in chunks, the (context, word)
    cells of a chunk are summed there and dealt out by word to buckets. After each
    sweep the buckets' sums per context are dealt out by context, added up and sent
    back; only sums at the root pass the driver. A frequent word is one cell per chunk
    and context, and a frequent context one sum per bucket.

    Returns `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`;
    `base_score` is that of add-one counts. Null and empty texts are one end.
    Repeated rows and null ids are rows like others. Without training rows every
    word is unknown. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    chunks = stored(_chunks(rows), "lm-chunks")
    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    size = chunks.select(tokens.alias("n")).agg(F.sum("n")).first()[0] or 0
    # About seven tenths of a chunk's tokens are cells that it had not had yet.
    buckets = max(1, round(0.7 * size / BUCKET_CELLS))
    merged = stored(_merge(_requests(chunks, buckets)), "lm-buckets")
    settings = _settings(merged)
    # Dealt out once for all sweeps; what is lost is made again from the stored buckets.
    cells = merged.select("bucket", "words", "contexts", "keys", "counts")
    cells = cells.repartition(buckets, "bucket").persist(StorageLevel.DISK_ONLY)
    sums, roots = chunks.sparkSession.createDataFrame([], SUMS), []
    for _ in range(SWEEPS + 1):
        found, root = _after(cells, sums, settings, roots, buckets)
        sums, roots = sums.unionByName(found), [*roots, root]
    cells.unpersist()
    scored = _score(chunks, _answers(merged, sums, settings, roots, buckets), buckets, settings)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(settings.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
