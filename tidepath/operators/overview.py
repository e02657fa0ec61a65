"""Headline numbers, volume over time, places and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.measures import MONEY, side_column, transfer_count, volume
from tidepath.functions.periods import period_start


def totals(moves: DataFrame) -> DataFrame:
    """Number, volume, distinct parties and paths, and the largest amount.

    Spark splits the two distinct counts by group id and combines rows before
    the shuffle: each task sends its distinct parties and paths, not its rows.
    """
    return moves.agg(
        transfer_count(moves),
        volume(moves),
        F.countDistinct("party").alias("parties"),
        F.countDistinct("src", "dst").alias("paths"),
        F.max("amount").cast(MONEY).alias("max_amount"),
    )


def by_period(moves: DataFrame, unit: str = "month") -> DataFrame:
    return moves.groupBy(period_start(F.col("sent_at"), unit).alias("period")).agg(
        transfer_count(moves), volume(moves)
    )


def by_place(moves: DataFrame, side: str = "src") -> DataFrame:
    """Number, volume and distinct parties of each sending or receiving place.

    The first shuffle is on place and party, so a place with a large share of
    the rows is spread over all tasks.
    """
    return moves.groupBy(side_column(side).alias("place")).agg(
        transfer_count(moves), volume(moves), F.countDistinct("party").alias("parties")
    )


def path_totals(moves: DataFrame) -> DataFrame:
    return moves.groupBy("src", "dst").agg(transfer_count(moves), volume(moves))


def paths(moves: DataFrame) -> DataFrame:
    """Flow of each path and its share of the whole volume in percent.

    Only the summed paths, at most places squared, reach the window.
    """
    whole = F.sum("volume").over(Window.partitionBy()).cast("double")
    share = F.round(F.col("volume").cast("double") * 100 / F.nullif(whole, F.lit(0.0)), 4)
    return path_totals(moves).select("src", "dst", "n", "volume", share.alias("share_pct"))


def top_paths_per_period(moves: DataFrame, unit: str = "month", k: int = 3) -> DataFrame:
    """The `k` paths with the largest volume in each period; ties go by name."""
    summed = moves.groupBy(
        period_start(F.col("sent_at"), unit).alias("period"), "src", "dst"
    ).agg(volume(moves))
    order = Window.partitionBy("period").orderBy(
        F.desc_nulls_last("volume"), F.asc_nulls_last("src"), F.asc_nulls_last("dst")
    )
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
