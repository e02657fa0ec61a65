"""Series over time and rankings.

The windows here have no partition column and so run in one task. What reaches
them is already summed by period or place: its size is set by the calendar or
the list of places, never by the number of transfers.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.measures import MONEY, side_column, transfer_count, volume
from tidepath.functions.periods import as_day, day_of
from tidepath.operators.overview import by_period
from tidepath.operators.transfers import transfers_filtered


def _daily_counts(moves: DataFrame) -> DataFrame:
    return moves.groupBy(day_of(F.col("sent_at")).alias("day")).agg(transfer_count(moves))


def daily_zero_filled(
    moves: DataFrame,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
) -> DataFrame:
    """Transfers on each day from `start` to `end`, both included; 0 where none.

    A bound left out is the first or last day with transfers. The calendar is
    added as rows with 0 and summed along, which needs no join.
    """
    after = F.date_add(as_day(end), 1).cast("timestamp_ntz") if end is not None else None
    moves = transfers_filtered(moves, start=start)
    if after is not None:
        moves = moves.where(F.col("sent_at") < after)
    counts = _daily_counts(moves).where(F.col("day").isNotNull())
    first = F.min("day") if start is None else F.max(as_day(start))
    last = F.max("day") if end is None else F.max(as_day(end))
    if start is not None and end is not None:
        edges = moves.sparkSession.range(1).select(
            as_day(start).alias("first"), as_day(end).alias("last")
        )
    else:
        edges = counts.agg(first.alias("first"), last.alias("last"))
    edges = edges.where(F.col("first") <= F.col("last"))
    calendar = edges.select(F.explode(F.sequence("first", "last")).alias("day"))
    filled = counts.unionByName(calendar.withColumn("n", F.lit(0).cast("bigint")))
    return (
        filled.groupBy("day")
        .agg(F.sum("n").alias("n"))
        .select(F.col("day").cast("timestamp_ntz").alias("day"), "n")
    )


def cumulative(moves: DataFrame, unit: str = "month") -> DataFrame:
    so_far = Window.orderBy(F.asc_nulls_last("period")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return by_period(moves, unit).select(
        "period", F.sum("volume").over(so_far).cast(MONEY).alias("cum_volume")
    )


def period_change(moves: DataFrame, unit: str = "month") -> DataFrame:
    """Change of the count from the previous period that has transfers."""
    before = F.lag("n").over(Window.orderBy(F.asc_nulls_last("period")))
    change = F.col("n") - before
    return by_period(moves, unit).select(
        "period",
        change.alias("diff_n"),
        F.round(change.cast("double") * 100 / before, 4).alias("diff_pct"),
    )


def rolling_7d(moves: DataFrame) -> DataFrame:
    """Transfers in the seven days up to each day that has transfers."""
    counts = _daily_counts(moves).where(F.col("day").isNotNull())
    week = Window.orderBy("day_number").rangeBetween(-6, Window.currentRow)
    return counts.withColumn("day_number", F.unix_date("day")).select(
        F.col("day").cast("timestamp_ntz").alias("day"), F.sum("n").over(week).alias("n_7d")
    )


def rank_places(moves: DataFrame, side: str = "src") -> DataFrame:
    """Places by volume, largest first; equal volumes share a rank."""
    summed = moves.groupBy(side_column(side).alias("place")).agg(volume(moves))
    order = Window.orderBy(F.desc_nulls_last("volume"))
    return summed.withColumn("rank", F.rank().over(order))
