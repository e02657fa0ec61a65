"""Writers for overview tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_overview(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str] = (),
    *,
    replace: str = "all",
) -> None:
    """Store `df` as Parquet in one folder per value of `partition_cols`.

    `replace="all"` swaps the whole table, `replace="touched"` only the folders
    that `df` has rows for. The rebalance step gathers the rows of a folder so it
    gets few files; adaptive execution still splits a folder that holds a large
    share of the rows over several tasks.
    """
    if replace not in ("all", "touched"):
        raise ValueError(f"replace must be 'all' or 'touched', not {replace!r}")
    columns = list(partition_cols)
    ready = df.hint("rebalance", *columns) if columns else df.hint("rebalance")
    writer = ready.write.mode("overwrite")
    if columns:
        mode = "dynamic" if replace == "touched" else "static"
        writer = writer.option("partitionOverwriteMode", mode).partitionBy(*columns)
    writer.parquet(path)
