"""The two additive measures: number of transfers and volume.

Additive operators run on raw transfers (one row each, `amount`) or on the
daily cube (`n` and `volume` already summed). These helpers pick the right
expression from the columns, so both inputs give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def transfer_count(df: DataFrame) -> Column:
    counted = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return counted.alias("n")


def volume(df: DataFrame) -> Column:
    """Sum kept in decimals: no drift, and no dependence on summing order."""
    summed = F.sum("volume" if "volume" in df.columns else "amount")
    return summed.cast(MONEY).alias("volume")


def side_column(side: str) -> Column:
    if side not in ("src", "dst"):
        raise ValueError(f"side must be 'src' or 'dst', not {side!r}")
    return F.col(side)
