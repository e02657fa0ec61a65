"""Who moves: largest, broadest, new, returning and latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.measures import transfer_count, volume
from tidepath.functions.periods import day_of, period_start


def top_parties(moves: DataFrame, k: int = 20) -> DataFrame:
    """The `k` parties with the largest volume; ties go by party."""
    return (
        moves.groupBy("party")
        .agg(volume(moves), transfer_count(moves))
        .orderBy(F.desc_nulls_last("volume"), F.asc_nulls_last("party"))
        .limit(k)
    )


def party_breadth(moves: DataFrame) -> DataFrame:
    """How many parties use how many different paths."""
    known = moves.where(F.col("party").isNotNull())
    used = known.select("party", "src", "dst").distinct()
    return (
        used.groupBy("party")
        .agg(F.count(F.lit(1)).alias("paths"))
        .groupBy("paths")
        .agg(F.count(F.lit(1)).alias("parties"))
    )


def status_by_month(moves: DataFrame) -> DataFrame:
    return moves.groupBy(
        period_start(F.col("sent_at"), "month").alias("period"), "status"
    ).agg(transfer_count(moves), volume(moves))


def _active_months(moves: DataFrame) -> DataFrame:
    """Each month a party moved something, with the party's first month.

    Reduced to one row per party and month before the window, so a party with
    a large share of the transfers brings no more rows than there are months.
    """
    known = moves.where(F.col("party").isNotNull() & F.col("sent_at").isNotNull())
    active = known.select(
        "party", F.trunc(day_of(F.col("sent_at")), "month").alias("month")
    ).distinct()
    return active.withColumn("first_month", F.min("month").over(Window.partitionBy("party")))


def new_and_returning(moves: DataFrame) -> DataFrame:
    """Parties in their first month, and parties seen before, by month."""
    is_new = F.col("month") == F.col("first_month")
    return (
        _active_months(moves)
        .groupBy("month")
        .agg(F.count_if(is_new).alias("new"), F.count_if(~is_new).alias("returning"))
        .select(F.col("month").cast("timestamp_ntz").alias("period"), "new", "returning")
    )


def cohort_retention(moves: DataFrame) -> DataFrame:
    """Parties of each first month still active `k` months later."""
    later = F.months_between("month", "first_month").cast("int")
    return (
        _active_months(moves)
        .groupBy("first_month", later.alias("k"))
        .agg(F.count(F.lit(1)).alias("parties"))
        .select(F.col("first_month").cast("timestamp_ntz").alias("cohort"), "k", "parties")
    )


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by `order`, then by the remaining columns.

    Spark keeps one row per key in each task before the shuffle, so a key with
    very many rows does not meet in one task.
    """
    rest = [name for name in rows.columns if name not in (*keys, *order)]
    ranking: list[Column] = [F.desc_nulls_last(name) for name in (*order, *rest)]
    newest = Window.partitionBy(*keys).orderBy(*ranking)
    return (
        rows.withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def approx_parties(moves: DataFrame, rsd: float = 0.05, exact: bool = False) -> DataFrame:
    """Estimated number of parties; `rsd` is the relative standard deviation.

    With `exact` the true number comes along as `parties`, from the same pass.
    """
    counts = [F.approx_count_distinct("party", rsd).alias("approx_parties")]
    if exact:
        counts.append(F.countDistinct("party").alias("parties"))
    return moves.agg(*counts)
