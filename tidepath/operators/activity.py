"""Activity by weekday and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekday_hour(events: DataFrame) -> DataFrame:
    """Events by weekday (0 is Sunday) and hour of the day."""
    weekday = F.dayofweek(F.col("ts").cast("date")) - 1
    return events.groupBy(weekday.alias("weekday"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
