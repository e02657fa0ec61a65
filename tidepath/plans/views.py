"""The transfers table as a view for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepath.operators import transfers
from tidepath.sources import read_tables


def place_names(nation: DataFrame) -> list[str]:
    """The nation names in order, to be column names of the matrix.

    Meant for a table of places that is as short as a row can be wide; for any
    number of places use `path_counts`, which needs no list.
    """
    rows = nation.select("n_name").where("n_name is not null").distinct().collect()
    return sorted(row.n_name for row in rows)


def load_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return transfers(read_tables(spark, folder))


def register_transfers(spark: SparkSession, folder: str, name: str = "transfers") -> DataFrame:
    """Make `spark.sql("select ... from transfers")` work for this folder."""
    moves = load_transfers(spark, folder)
    moves.createOrReplaceTempView(name)
    return moves
