"""The overview tables in one job: all but B16, B17 and the estimate B18.

usage: python -m tidepath.plans.overview_job SOURCE TARGET [START END]

The joins behind the transfers run once: their result is stored by month and
everything else reads that. What only counts and sums reads a daily cube made
from it, whose size depends on days and places only. With START and END only the
months they touch are made anew in an existing target, whole, and the overviews
cover all months stored there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath import operators as ops
from tidepath.functions.periods import as_moment
from tidepath.operators.transfers import TRANSFER_COLUMNS
from tidepath.session import build_session
from tidepath.sources import read_tables, write_overview
from tidepath.sources.tables import TRANSFER_TABLES

Moment = str | date | datetime | None

BAND_EDGES = ("25000.00", "75000.00")

FROM_CUBE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "by_day": lambda cube: ops.by_period(cube, "day"),
    "by_week": lambda cube: ops.by_period(cube, "week"),
    "by_month": lambda cube: ops.by_period(cube, "month"),
    "paths": ops.paths,
    "top_paths_per_month": ops.top_paths_per_period,
    "daily_zero_filled": ops.daily_zero_filled,
    "cumulative": ops.cumulative,
    "period_change": ops.period_change,
    "rolling_7d": ops.rolling_7d,
    "rank_src": lambda cube: ops.rank_places(cube, "src"),
    "rank_dst": lambda cube: ops.rank_places(cube, "dst"),
    "net_flow": ops.net_flow,
    "status_by_month": ops.status_by_month,
}

FROM_TRANSFERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "totals": ops.totals,
    "by_src": lambda moves: ops.by_place(moves, "src"),
    "by_dst": lambda moves: ops.by_place(moves, "dst"),
    "amount_quantiles": ops.amount_quantiles,
    "top_parties": ops.top_parties,
    "party_breadth": ops.party_breadth,
    "new_and_returning": ops.new_and_returning,
    "cohort_retention": ops.cohort_retention,
}


def whole_months(start: Moment, end: Moment) -> tuple[date | None, date | None]:
    """The window widened to the first of `start`'s month and the end of `end`'s."""

    def first(moment: Moment, up: bool) -> date | None:
        if moment is None:
            return None
        when = datetime.fromisoformat(moment if isinstance(moment, str) else moment.isoformat())
        month = datetime(when.year, when.month, 1, tzinfo=when.tzinfo)
        if up and when > month:
            month = month.replace(year=when.year + when.month // 12, month=when.month % 12 + 1)
        return month.date()

    return first(start, up=False), first(end, up=True)


def _month_files(spark: SparkSession, path: str, start: Moment, end: Moment) -> set[str]:
    """Files of the stored months that the window touches; none if nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return set()
    stored = spark.read.schema("month string").parquet(path)
    if start is not None:
        stored = stored.where(F.col("month") >= F.date_format(as_moment(start), "yyyy-MM"))
    if end is not None:
        stored = stored.where(F.col("month") < F.date_format(as_moment(end), "yyyy-MM"))
    names = stored.select(F.input_file_name().alias("file")).distinct()
    return {row.file for row in names.collect()}


def store_transfers(
    moves: DataFrame, path: str, replace: str = "all", start: Moment = None, end: Moment = None
) -> None:
    """Store transfers in one folder per month of `sent_at`.

    With `replace="touched"` the months that `moves` has rows for are replaced and
    the others are left alone, so it must hold these months whole (`whole_months`).
    If the window `start` to `end` is given, months in it that `moves` has no rows for
    any more are taken out as well: those whose files the write has not replaced.
    """
    spark = moves.sparkSession
    by_month = moves.withColumn("month", F.date_format("sent_at", "yyyy-MM"))
    windowed = replace == "touched" and not (start is None and end is None)
    before = _month_files(spark, path, start, end) if windowed else set()
    write_overview(by_month, path, ("month",), replace=replace)
    stale = before & _month_files(spark, path, start, end) if windowed else set()
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in stale}:
        month = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        month.getFileSystem(hadoop).delete(month, True)


def stored_transfers(
    spark: SparkSession, path: str, start: Moment = None, end: Moment = None
) -> DataFrame:
    """Stored transfers with `start <= sent_at < end`; other months are not opened."""
    moves = ops.transfers_filtered(spark.read.parquet(path), start, end)
    if start is not None:
        moves = moves.where(F.col("month") >= F.date_format(as_moment(start), "yyyy-MM"))
    if end is not None:
        moves = moves.where(F.col("month") <= F.date_format(as_moment(end), "yyyy-MM"))
    return moves.select(*TRANSFER_COLUMNS)


def write_overview_tables(
    spark: SparkSession,
    source: str,
    target: str,
    start: Moment = None,
    end: Moment = None,
    band_edges: tuple[str, str] = BAND_EDGES,
    replace: str | None = None,
) -> list[str]:
    """Read the base tables in `source`, store every overview in `target`.

    A run with `start` or `end` refreshes the whole months they touch and leaves
    other stored months alone; with `replace="all"` only the window is stored.
    Returns the names of the stored tables.
    """
    replace = replace or ("all" if start is None and end is None else "touched")
    if replace == "touched":
        start, end = whole_months(start, end)
    tables = read_tables(spark, source, (*TRANSFER_TABLES, "region"))
    nation, region = tables["nation"], tables["region"]
    target = target.rstrip("/")
    selected = ops.transfers_filtered(ops.transfers(tables), start, end)
    store_transfers(selected, f"{target}/transfers", replace, start, end)
    moves = stored_transfers(spark, f"{target}/transfers")
    write_overview(ops.daily_cube(moves), f"{target}/daily_cube")
    cube = spark.read.parquet(f"{target}/daily_cube")
    # Distinct parties and quantiles of any days and places, without the transfers.
    write_overview(ops.daily_sketches(moves), f"{target}/daily_sketches")
    overviews = {name: operator(cube) for name, operator in FROM_CUBE.items()}
    overviews |= {name: operator(moves) for name, operator in FROM_TRANSFERS.items()}
    overviews["region_subtotals"] = ops.region_subtotals(cube, nation, region)
    overviews["path_counts"] = ops.path_counts(cube)
    overviews["size_bands"] = ops.size_bands(moves, band_edges)
    for name, overview in overviews.items():
        write_overview(overview, f"{target}/{name}")
    return ["transfers", "daily_cube", "daily_sketches", *overviews]


if __name__ == "__main__":
    if len(sys.argv) not in (3, 5):
        sys.exit("usage: overview_job SOURCE TARGET [START END]")
    write_overview_tables(build_session(), *sys.argv[1:])
