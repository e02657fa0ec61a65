"""Streaming operators: each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.sources.tables import SCHEMAS

# Names under which a session time zone means UTC.
UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")


def read_event_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New event files in `path`, with `t`, the event time a watermark accepts.

    A watermark needs a `timestamp`, and day windows start at midnight UTC, so
    the session time zone must be UTC for `ts` to keep its clock reading.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC; it is {zone}")
    reader = spark.readStream.schema(SCHEMAS["events"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).withColumn("t", F.col("ts").cast("timestamp"))


def live_daily(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per day. In append mode a day appears once `delay` has passed."""
    return (
        stream.withWatermark("t", delay)
        .groupBy(F.window("t", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")
    )


def stream_dedupe(
    stream: DataFrame,
    keys: Sequence[str] = ("event_id",),
    delay: str = "1 hour",
    splits: int = 1,
) -> DataFrame:
    """Drop events re-sent within `delay` of their first arrival.

    By default there is one step and one state. Where an event can be sent very many
    times, set `splits` to about the number of cores: copies are then dropped first among
    those read by one of `splits` groups of tasks, and then among the at most `splits`
    that are left. That spreads such an event over several tasks, for twice the state.
    """
    marked = stream.withWatermark("t", delay)
    if splits > 1:
        group = F.spark_partition_id() % splits
        marked = (
            marked.withColumn("_group", group)
            .dropDuplicatesWithinWatermark([*keys, "_group"])
            .drop("_group")
        )
    return marked.dropDuplicatesWithinWatermark(list(keys))


def user_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Bursts of a user's events with less than `gap` between them.

    `session_end` is the last event plus `gap`. A session appears once the
    watermark has passed its end.
    """
    return (
        stream.withWatermark("t", delay)
        .groupBy(F.session_window("t", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "user_id",
            F.col("w.start").cast("timestamp_ntz").alias("session_start"),
            F.col("w.end").cast("timestamp_ntz").alias("session_end"),
            "n",
        )
    )
