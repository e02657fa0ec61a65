"""Near-duplicate vectors by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import stored
from tidepath.llm.components import components

# Vectors of one bucket are compared in blocks of about so many.
BLOCK = 1024
# Keys of a vector in each table: its own bucket and the likeliest next ones.
PROBES = 3
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.concatenate(
            [pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2
        ).reshape(n, width)
        half *= 2
    return x / math.sqrt(width)


class CrossPolytope:
    """Keys of unit vectors: per table, `functions` rotations, each with its nearest axis.

    A rotation is three rounds of random signs and a fast Hadamard transform.
    Besides its own bucket, a vector is put into those where one function takes
    its second nearest axis, the closest calls first (multiprobe).
    """

    def __init__(self, dims: int, tables: int, functions: int, seed: int = SEED):
        self.width = 1 << max(1, (dims - 1).bit_length())
        self.tables, self.functions = tables, functions
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, functions, 3, self.width))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """`len(unit)` x tables x `PROBES` keys, those of different tables being different."""
        n, dims = unit.shape
        wide = np.zeros((n, self.width))
        wide[:, :dims] = unit
        rows = np.arange(n)
        out = np.zeros((n, self.tables, PROBES), np.int64)
        base = 2 * self.width
        for table in range(self.tables):
            first, second, loss = [], [], []
            for function in range(self.functions):
                turned = wide
                for signs in self.signs[table, function]:
                    turned = hadamard(turned * signs)
                size = np.abs(turned)
                top = np.argpartition(-size, 1, axis=1)[:, :2]
                swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
                top[swap] = top[swap][:, ::-1]
                values = turned[rows[:, None], top]
                axis = top + self.width * (values < 0)
                first.append(axis[:, 0])
                second.append(axis[:, 1])
                loss.append(np.abs(values[:, 0]) - np.abs(values[:, 1]))
            easiest = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
            for probe in range(PROBES):
                key = np.full(n, table, np.int64)
                for function in range(self.functions):
                    moved = (probe > 0) & (easiest[:, min(probe, self.functions) - 1] == function)
                    key = key * base + np.where(moved, second[function], first[function])
                out[:, table, probe] = key
        return out


def plan_tables(vectors: int, dims: int) -> tuple[int, int]:
    """Functions per table, so that a bucket of unrelated vectors stays small, and tables.

    A bucket should hold about 8 vectors by chance; each function more makes a
    close pair likelier to part, so the tables are doubled for it.
    """
    base = 2 * (1 << max(1, (dims - 1).bit_length()))
    functions = max(2, math.ceil(math.log(max(1, vectors / 8), base)))
    return functions, 12 * 2 ** (functions - 2)


def _usable(rows: DataFrame) -> DataFrame:
    """`vec_id, node, vector`: `node` is a hash of the vector, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for vector in batch.column(1).to_pylist():
                values = None if vector is None or None in vector else np.array(vector, float)
                usable = values is not None and np.isfinite(values).all() and values.any()
                nodes.append(
                    xxhash.xxh3_64_intdigest((values + 0.0).tobytes()) - 2**63 if usable else None
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), batch.column(1)],
                names=["vec_id", "node", "vector"],
            )

    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, node long, vector {kinds['vector']}"
    return rows.mapInArrow(run, schema)


def _units(vectors: list[list[float]]) -> np.ndarray:
    """Unit vectors; scaling by the largest component first keeps tiny and huge ones exact."""
    x = np.array(vectors, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _with_keys(classes: DataFrame, tables: int, functions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                vectors = part.column(2).to_pylist()
                keys = [None] * len(vectors)
                for dims in {len(v) for v in vectors}:
                    at = [i for i, v in enumerate(vectors) if len(v) == dims]
                    hashes = CrossPolytope(dims, tables, functions).keys(
                        _units([vectors[i] for i in at])
                    )
                    for i, row in zip(at, hashes.reshape(len(at), -1)):
                        # Vectors of different lengths never share a bucket.
                        keys[i] = [xxhash.xxh3_64_intdigest(b"%d:%d" % (dims, k)) - 2**63 for k in row.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(keys, pa.list_(pa.int64()))],
                    names=["node", "n", "vector", "keys"],
                )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.mapInArrow(run, f"node long, n long, vector {kind}, keys array<long>")


def compare(
    key: int, cross: bool, left: list[tuple], right: list[tuple], least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks of a bucket (within one block if not `cross`).

    Entries are (node, n, vector, keys). Returns the pairs whose first shared key
    is this one, as places in `left + right`, and the label of each place: the
    smallest place its links lead to.
    """
    entries = left + right
    unit = _units([e[2] for e in entries])
    split = len(left)
    if cross:
        a, b = np.nonzero(unit[:split] @ unit[split:].T >= least - 1e-9)
        b = b + split
    else:
        a, b = np.nonzero(np.triu(unit @ unit.T >= least - 1e-9, 1))
    exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
    a, b = a[exact], b[exact]
    label = np.arange(len(entries))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    first = np.zeros(len(a), bool)
    keys = np.array([e[3] for e in entries]) if len(a) else None
    for start in range(0, len(a), 4096):
        part = slice(start, start + 4096)
        ours, theirs = keys[a[part]], keys[b[part]]
        shared = np.full(len(ours), np.iinfo(np.int64).max)
        width = PROBES
        for at in range(0, ours.shape[1], width):
            x, y = ours[:, at : at + width], theirs[:, at : at + width]
            same = (x[:, :, None] == y[:, None, :]).any(axis=2)
            shared = np.minimum(shared, np.where(same, x, np.iinfo(np.int64).max).min(axis=1))
        first[part] = shared == key
    return a[first], b[first], label, np.array([e[1] for e in entries], np.int64)


def _compare_blocks(members: DataFrame, least: float) -> DataFrame:
    """`node, links, to`: links found by block pair, and a node each leads to."""

    def results(cell: tuple, entries: list[tuple]) -> Iterator[tuple]:
        key, x, y = cell
        left = [e[1:] for e in entries if e[0] == x]
        right = [e[1:] for e in entries if e[0] != x]
        if len(left) + len(right) < 2 or (x != y and not (left and right)):
            return
        a, b, label, sizes = compare(key, x != y, left, right, least)
        nodes = [e[0] for e in left + right]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, sizes[b])
        np.add.at(links, b, sizes[a])
        for at in np.flatnonzero((links > 0) | (label != np.arange(len(nodes)))).tolist():
            yield nodes[at], int(links[at]), nodes[label[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, entries = None, []

        def flush() -> list[tuple]:
            return list(results(cell, entries)) if entries else []

        for batch in batches:
            found = []
            for key, x, y, *entry in zip(*(column.to_pylist() for column in batch.columns)):
                if cell != (key, x, y):
                    found += flush()
                    cell, entries = (key, x, y), []
                entries.append(tuple(entry))
            yield _arrow(found)
        yield _arrow(flush())

    def _arrow(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["node", "links", "to"])

    return members.mapInArrow(run, "node long, links long, to long")


def near_vectors(
    rows: DataFrame, least: float = 0.9, tables: int | None = None, functions: int | None = None
) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for every row of `rows` (`vec_id, embedding`).

    Vectors are linked whose cosine in double precision is at least `least`, among
    the pairs that share a bucket of a cross-polytope hash. Equal vectors are one
    from the start and count as often as they occur. A pair is counted in the
    first of its shared buckets only. A large bucket is cut into blocks that are
    compared two by two, so no task holds more than two blocks, and no pair
    becomes a row: blocks give sums of links and one way to the smallest
    neighbour each.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, as do vectors of different lengths with each other. Repeated
    rows are vectors of their own. Null ids come after all others, so they name a
    component only if it has no other id. An empty table gives an empty result.
    """
    marked = stored(
        _usable(rows.select("vec_id", F.col("embedding").alias("vector"))), "vectors"
    )
    good = marked.where("node is not null")
    classes = stored(
        good.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector")),
        "vector-classes",
    )
    shape = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    by_size = plan_tables(shape[0], shape[1] or 1)
    hashed = stored(
        _with_keys(classes, tables or by_size[1], functions or by_size[0]), "vector-keys"
    )
    buckets = hashed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = (
        buckets.groupBy("key")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held > 1")
        .select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    )
    placed = (
        buckets.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node",
            "key",
            F.least("block", "other").alias("x"),
            F.greatest("block", "other").alias("y"),
            "block",
        )
    )
    members = (
        placed.join(hashed, "node")
        .select("key", "x", "y", "block", "node", "n", "vector", "keys")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
    )
    found = stored(_compare_blocks(members, least), "vector-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = (
        classes.select("node", "n")
        .join(sums, "node", "left")
        .join(groups, "node", "left")
        .select(
            "node",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    rows = marked.select("vec_id", "node").join(named, "node", "left")
    smallest = (
        rows.where("component is not null")
        .groupBy("component")
        .agg(F.min("vec_id").alias("component_id"))
    )
    component_id = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(
        F.col("component_id")
    )
    return rows.join(smallest, "component", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )
