"""Which rows have a partner, what two tables have in common, and several groupings at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.functions.measures import MONEY, transfer_count, volume

# Keys sent to every task before a join stay below both of these.
MOST_KEYS = 1_000_000
MOST_KEY_BYTES = 32 * 2**20


def _small(keys: DataFrame, most_keys: int, most_bytes: int) -> bool:
    """Whether the rows are few and short; counts at most one row beyond the bound."""
    sizes = reduce(Column.__add__, (F.octet_length(F.col(c).cast("string")) for c in keys.columns))
    found = keys.limit(most_keys + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sizes).alias("size")).first()
    return found.n <= most_keys and (found.size or 0) <= most_bytes


def with_partner(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    partner: bool = True,
    most_keys: int = MOST_KEYS,
    most_bytes: int = MOST_KEY_BYTES,
) -> DataFrame:
    """Rows of `left` that have a row of `right` with the same key, or have none.

    `on` maps key columns of `left` to those of `right`. A null key has no partner, so
    its rows are left out with `partner`, and kept without. No row is multiplied.

    `right` is cut to its distinct keys in each task before it is shuffled, so a hot key
    is one row a task. If the keys of `left` are at most `most_keys` and `most_bytes`
    (counted first, up to the bound), they are sent ahead: rows of `right` with other keys
    go before the shuffle. Beyond the bound the join is the same without that filter.
    """
    names = [f"_k{i}" for i in range(len(on))]
    known = reduce(Column.__and__, (F.col(name).isNotNull() for name in names))
    wanted = left.select(*(F.col(c).alias(n) for n, c in zip(names, on))).where(known).distinct()
    keys = right.select(*(F.col(c).alias(n) for n, c in zip(names, on.values()))).where(known)
    if _small(wanted, most_keys, most_bytes):
        keys = keys.join(F.broadcast(wanted), names, "left_semi")
    same = reduce(Column.__and__, (left[c] == F.col(n) for n, c in zip(names, on)))
    return left.join(keys.distinct(), same, "left_semi" if partner else "left_anti")


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    if left.columns != right.columns:
        raise ValueError("both tables must have the same columns in the same order")
    if {"n_left", "n_right"} & {name.lower() for name in left.columns}:
        raise ValueError("columns called n_left or n_right must be renamed")
    marked = left.withColumns({"n_left": F.lit(1), "n_right": F.lit(0)}).unionByName(
        right.withColumns({"n_left": F.lit(0), "n_right": F.lit(1)})
    )
    return marked.groupBy(*left.columns).agg(
        F.sum("n_left").cast("long").alias("n_left"), F.sum("n_right").cast("long").alias("n_right")
    )


def bag_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with `n_left` and `n_right`.

    Whole rows are compared, nulls as equal. Both tables are counted in one pass: tasks
    count their rows first, so a row repeated very often is one row a task in the shuffle,
    and what does not differ ends there.
    """
    return _counted(left, right).where("n_left <> n_right")


def _repeated(counted: DataFrame, times: Column) -> DataFrame:
    names = counted.columns[:-2]
    return counted.where(times > 0).withColumn("n_left", F.explode(F.sequence(F.lit(1), times))).select(*names)


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left`, less one for each equal row of `right`; repeats are kept."""
    return _repeated(_counted(left, right), F.col("n_left") - F.col("n_right"))


def bag_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both tables have, as often as both have them."""
    return _repeated(_counted(left, right), F.least("n_left", "n_right"))


def version_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How rows differ between two versions of a table: `keys`, `change`, `n_gone`, `n_come`.

    `change` is `removed` for a key that only the old version has among the differing
    rows, `added` for one that only the new one has, and `changed` for one with rows of
    both. Counts are of rows, repeats included. Keys without a difference are left out;
    nulls are equal.
    """
    more = F.col("n_left") - F.col("n_right")
    found = bag_changes(old, new).groupBy(*keys).agg(
        F.sum(F.greatest(more, F.lit(0))).alias("n_gone"), F.sum(F.greatest(-more, F.lit(0))).alias("n_come")
    )
    change = F.when(F.col("n_come") == 0, "removed").when(F.col("n_gone") == 0, "added").otherwise("changed")
    return found.select(*keys, change.alias("change"), "n_gone", "n_come")


def grouped_at_once(moves: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Number and volume for several groupings of transfers, told apart by `grouping`.

    `grouping` names the columns of the set, joined by commas; a column outside it is
    null. A null in a column of the set is a group like any other. Transfers are summed by
    all columns once; only those sums are multiplied by the number of sets.
    """
    if not sets or len({frozenset(s) for s in sets}) < len(sets):
        raise ValueError("give at least one set of columns, and each only once")
    columns = list(dict.fromkeys(name for names in sets for name in names))
    sums = moves.groupBy(*columns).agg(transfer_count(moves), volume(moves))
    if not columns:
        return sums.select(F.lit("").alias("grouping"), "n", "volume")
    used = [F.when(F.grouping(name) == 0, F.lit(name)) for name in columns]
    grouped = sums.groupingSets([[F.col(c) for c in names] for names in sets], *columns).agg(
        F.concat_ws(",", *used).alias("grouping"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.sum("volume").cast(MONEY).alias("volume"),
    )
    return grouped.select("grouping", *columns, "n", "volume")
