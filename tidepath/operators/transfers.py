"""The transfers table: one row per movement from a place to another."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.functions.measures import transfer_count, volume
from tidepath.functions.periods import as_moment, period_start

TRANSFER_COLUMNS = (
    "transfer_key",
    "sent_at",
    "party",
    "asset",
    "src",
    "dst",
    "status",
    "amount",
)


def transfers(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every lineitem whose supplier and customer sit in different nations.

    Lookups come before the one large join: lines get their source and orders
    their target first. So a filter on period, places or asset thins both sides
    before they are shuffled by order. Places are looked up for suppliers and
    customers, small with small, so the large tables never move by the few places.
    No join is forced: Spark broadcasts a side only when its size is below
    `spark.sql.autoBroadcastJoinThreshold`, as the orders of a narrow filter may
    be, and sort-merges it otherwise; adaptive execution then splits an order,
    supplier or party that holds much of the rows.
    """
    nation = tables["nation"]
    senders = nation.select(F.col("n_nationkey").alias("src_key"), F.col("n_name").alias("src"))
    receivers = nation.select(F.col("n_nationkey").alias("dst_key"), F.col("n_name").alias("dst"))
    suppliers = (
        tables["supplier"]
        .join(senders, F.col("s_nationkey") == F.col("src_key"))
        .select("s_suppkey", "src_key", "src")
    )
    customers = (
        tables["customer"]
        .join(receivers, F.col("c_nationkey") == F.col("dst_key"))
        .select("c_custkey", "dst_key", "dst")
    )
    lines = (
        tables["lineitem"]
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "src_key",
            "src",
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        )
    )
    sendings = (
        tables["orders"]
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "dst_key", "dst")
    )
    return (
        lines.join(sendings, F.col("l_orderkey") == F.col("o_orderkey"))
        .where(F.col("src_key") != F.col("dst_key"))
        .select(
            F.struct(
                F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")
            ).alias("transfer_key"),
            F.col("o_orderdate").alias("sent_at"),
            F.col("o_custkey").alias("party"),
            F.col("l_partkey").alias("asset"),
            "src",
            "dst",
            F.col("o_orderstatus").alias("status"),
            "amount",
        )
    )


def _one_of(column: str, wanted: Any) -> Column:
    if isinstance(wanted, Iterable) and not isinstance(wanted, str):
        return F.col(column).isin(*wanted)
    return F.col(column) == F.lit(wanted)


def transfers_filtered(
    moves: DataFrame,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
    src: Any = None,
    dst: Any = None,
    asset: Any = None,
    status: Any = None,
) -> DataFrame:
    """Transfers with `start <= sent_at < end` and the given values.

    A value may be one item or several. The conditions are on plain columns, so
    they reach the Parquet scans behind the joins.
    """
    if start is not None:
        moves = moves.where(F.col("sent_at") >= as_moment(start))
    if end is not None:
        moves = moves.where(F.col("sent_at") < as_moment(end))
    for column, wanted in (("src", src), ("dst", dst), ("asset", asset), ("status", status)):
        if wanted is not None:
            moves = moves.where(_one_of(column, wanted))
    return moves


def daily_cube(moves: DataFrame) -> DataFrame:
    """Transfers summed by day, path and status.

    Its size is set by days and places, not by transfers. The operators that
    only count and sum take it in place of the transfers.
    """
    return moves.groupBy(
        period_start(F.col("sent_at"), "day").alias("sent_at"), "src", "dst", "status"
    ).agg(transfer_count(moves), volume(moves))
