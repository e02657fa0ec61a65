"""Base tables in a warehouse, read over JDBC in parallel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.sources.tables import SCHEMAS, check_schema


def read_warehouse(
    spark: SparkSession,
    url: str,
    name: str,
    *,
    table: str | None = None,
    partition_column: str,
    lower_bound: str,
    upper_bound: str,
    num_partitions: int,
    fetch_size: int = 10_000,
    broadcast_rows: int = 0,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """One base table, fetched by `num_partitions` tasks, with the fixed schema.

    The bounds only set the stride: rows outside them land in the first and last
    task, so none are lost. Filters and column choice are sent to the warehouse.
    `customSchema` turns the warehouse's own number types into those of the
    schema. The JDBC driver jar and the credentials come from the caller's
    `options` and Spark settings.

    Spark knows no size for such a table and would shuffle the other side of a
    join with it. For a lookup table, `broadcast_rows` counts its rows, up to that
    number, and marks it for broadcast if it has no more; else it stays as it is.
    """
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; known: {sorted(SCHEMAS)}")
    if num_partitions < 1:
        raise ValueError("num_partitions must be at least 1")
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table or name,
        partitionColumn=partition_column,
        lowerBound=lower_bound,
        upperBound=upper_bound,
        numPartitions=str(num_partitions),
        fetchsize=str(fetch_size),
        preferTimestampNTZ="true",
        customSchema=", ".join(
            f"{field.name} {field.dataType.simpleString()}" for field in SCHEMAS[name]
        ),
        **(options or {}),
    )
    frame = reader.load()
    check_schema(frame.schema, SCHEMAS[name], f"{url} {table or name}")
    frame = frame.select(*(F.col(column).alias(column) for column in SCHEMAS[name].names))
    if broadcast_rows and frame.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return F.broadcast(frame)
    return frame
