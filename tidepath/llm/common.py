"""Helpers shared by the operators on documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.session import new_work_path

# Texts are worked on in slices of about so many characters, whatever Spark's
# batches hold, so that a task's memory does not follow the batch size.
SLICE_CHARS = 4_000_000
# Spark's setting to remove shuffled files at the end of a query.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write `df` to the shared work folder and read it back: lineage ends here.

    The files are packed well, as texts among them are the most that the folder holds.
    With `tidy`, what was shuffled for `df` leaves the disks as soon as it is written, and
    not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_work_path(spark, name)
    before = spark.conf.get(TIDY, "false")
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def id_order(df: DataFrame, column: str) -> Column:
    """A value that sorts rows by id with nulls last, and is never null.

    Whole numbers stay longs, which are cheap to move and to compare; there the largest
    long and null are one. Ids of other types come as a pair.
    """
    if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))
    return F.struct(F.col(column).isNull().alias("missing"), F.col(column).alias("id"))


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text each.

    Every row is kept; a text longer than the limit is a slice of its own.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def per_slice(
    df: DataFrame, text: str, schema: str, work: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """Run `work()` once per task; its result turns each slice into output columns.

    `schema` names and types the columns that the dictionary holds as lists.
    """
    column = df.columns.index(text)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        step = work()
        for batch in batches:
            for part in slices(batch, column):
                made = step(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        value
                        if isinstance(value, (pa.Array, pa.ChunkedArray))
                        else pa.array(value, field.type)
                        for field, value in ((f, made[f.name]) for f in arrow)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, out)


def utf8(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts as UTF-8; null is the empty text."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [value or b"" for value in values]
