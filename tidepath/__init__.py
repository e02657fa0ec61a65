"""Overview tables for transfers between places, as Spark DataFrames."""
