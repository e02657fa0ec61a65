"""Run a streaming DataFrame over the input that is there, then stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepath.session import SETTINGS, new_work_path

# Merges a busy user's events into sessions before they are shuffled.
MERGE_SESSIONS_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
# Where state is kept. Spark's default store cannot hold the several kinds of state
# (a map, timers) of a stateful processor.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _run(writer, spark, **settings: str) -> None:
    """Start with early session merging on, and wait for the end of the input.

    A query copies the session's settings when it starts, so the caller's own
    values can be put back at once. `settings` are further ones that this query needs.
    """
    needed = {MERGE_SESSIONS_EARLY: "true", **settings}
    before = {name: spark.conf.get(name, None) for name in needed}
    try:
        for name, value in needed.items():
            spark.conf.set(name, value)
        query = writer.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    query.awaitTermination()


def append_to_files(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Append finished rows to Parquet files and return what they hold.

    With the same `path` and `checkpoint` a later call goes on where this ended.
    """
    spark = stream.sparkSession
    path = path or new_work_path(spark, "stream")
    checkpoint = checkpoint or new_work_path(spark, "stream-checkpoint")
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    _run(writer, spark)
    return spark.read.schema(stream.schema).parquet(path)


def keep_latest(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Store the whole current result of an aggregation after each batch.

    Unlike `append_to_files` this also shows groups that are still open. Two folders
    are written in turn, so that only the last two results are kept however many
    batches there are, and the newest whole one stays readable while the next is
    written. A batch run twice replaces only itself.
    """
    spark = stream.sparkSession
    path = path or new_work_path(spark, "stream")
    checkpoint = checkpoint or new_work_path(spark, "stream-checkpoint")

    def store(batch: DataFrame, number: int, slot: int | None = None) -> None:
        marked = batch.withColumn("batch", F.lit(number).cast("long"))
        marked.write.mode("overwrite").parquet(f"{path}/slot={number % 2 if slot is None else slot}")

    # Holds no rows; there is something to read even if the source has nothing.
    store(spark.createDataFrame([], stream.schema), -1, slot=2)
    writer = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    _run(writer, spark)
    extra = [T.StructField("batch", T.LongType()), T.StructField("slot", T.IntegerType())]
    stored = spark.read.schema(T.StructType([*stream.schema.fields, *extra])).parquet(path)
    newest = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch", "slot")


def keep_sessions(
    changes: DataFrame, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Store what `session_changes` tells as a table of sessions, with `closed`.

    Closed sessions are appended, a folder for each batch. Open ones are a table of their
    own that each batch brings up to date from the one before; two folders are written in
    turn, so it is as large as what is open, and a batch run twice replaces only itself.
    With the same `path` and `checkpoint` a later call goes on where this ended.
    """
    spark = changes.sparkSession
    path = path or new_work_path(spark, "sessions")
    checkpoint = checkpoint or new_work_path(spark, "sessions-checkpoint")
    whole = T.StructType([*changes.drop("change").schema.fields, T.StructField("batch", T.LongType())])
    session = ["user_id", "session_start"]

    def open_after(number: int) -> DataFrame:
        found = spark.read.schema(whole).parquet(f"{path}/open/slot={number % 2}")
        return found.where(F.col("batch") == number).drop("batch")

    def store(batch: DataFrame, number: int) -> None:
        # One batch can open a session, let it grow and close it: its last change holds.
        rank = F.when(F.col("change") == "open", 0).when(F.col("change") == "closed", 1).otherwise(2)
        rank = F.struct(rank, F.col("n"))
        last = batch.groupBy(*session).agg(F.max_by(F.struct("session_end", "n", "change"), rank).alias("c"))
        last = last.select(*session, "c.*").persist()
        try:
            closed = last.where("change = 'closed'").drop("change")
            closed.write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
            now = last.where("change = 'open'").drop("change")
            if number > 0:
                same = reduce(Column.__and__, (F.col(f"o.{c}").eqNullSafe(F.col(f"l.{c}")) for c in session))
                rest = open_after(number - 1).alias("o").join(last.alias("l"), same, "left_anti")
                now = rest.unionByName(now)
            now.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(
                f"{path}/open/slot={number % 2}"
            )
        finally:
            last.unpersist()

    # Hold no rows; there is something to read even if the source has nothing.
    none = spark.createDataFrame([], whole)
    none.write.mode("ignore").parquet(f"{path}/open/slot=none")
    none.drop("batch").write.mode("ignore").parquet(f"{path}/closed/batch=-1")
    writer = (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    _run(writer, spark, **{STATE_STORE: SETTINGS[STATE_STORE]})
    closed = spark.read.schema(changes.drop("change").schema).parquet(f"{path}/closed")
    opened = spark.read.schema(whole).parquet(f"{path}/open")
    newest = opened.agg(F.max("batch")).first()[0]
    opened = opened.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch", "slot")
    return (
        closed.drop("batch")
        .withColumn("closed", F.lit(True))
        .unionByName(opened.withColumn("closed", F.lit(False)))
    )
