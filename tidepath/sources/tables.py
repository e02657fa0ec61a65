"""Base tables in Parquet, read with a fixed schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


INT, BIGINT, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
STRING, MOMENT = T.StringType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Column names and types of the base tables.
SCHEMAS = {
    "region": _schema(r_regionkey=INT, r_name=STRING),
    "nation": _schema(n_nationkey=INT, n_name=STRING, n_regionkey=INT),
    "customer": _schema(
        c_custkey=BIGINT,
        c_name=STRING,
        c_nationkey=INT,
        c_acctbal=DOUBLE,
        c_mktsegment=STRING,
    ),
    "supplier": _schema(s_suppkey=BIGINT, s_name=STRING, s_nationkey=INT, s_acctbal=DOUBLE),
    "orders": _schema(
        o_orderkey=BIGINT,
        o_custkey=BIGINT,
        o_orderstatus=STRING,
        o_totalprice=DOUBLE,
        o_orderdate=MOMENT,
        o_orderpriority=STRING,
    ),
    "lineitem": _schema(
        l_orderkey=BIGINT,
        l_partkey=BIGINT,
        l_suppkey=BIGINT,
        l_linenumber=INT,
        l_quantity=DOUBLE,
        l_extendedprice=DOUBLE,
        l_discount=DOUBLE,
        l_tax=DOUBLE,
        l_returnflag=STRING,
        l_linestatus=STRING,
        l_shipdate=MOMENT,
    ),
    "events": _schema(
        event_id=BIGINT,
        ts=MOMENT,
        user_id=BIGINT,
        event_type=STRING,
        value=DOUBLE,
        props=STRING,
    ),
}

TRANSFER_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def check_schema(found: T.StructType, expected: T.StructType, what: str) -> None:
    """Raise if a column is missing or has another type; case does not matter."""
    types = {field.name.lower(): field.dataType for field in found}
    wrong = [
        f"{field.name}: expected {field.dataType.simpleString()}, found "
        + (types[field.name].simpleString() if field.name in types else "nothing")
        for field in expected
        if types.get(field.name) != field.dataType
    ]
    if wrong:
        raise ValueError(f"{what} does not have the expected columns: " + "; ".join(wrong))


def read_tables(
    spark: SparkSession,
    folder: str,
    names: Iterable[str] = TRANSFER_TABLES,
    check: bool = True,
) -> dict[str, DataFrame]:
    """The named tables as lazy DataFrames with the fixed schema.

    One Parquet footer per table is read at once and compared with the schema, as
    Spark reads a column that the files lack as all nulls. It costs a small job
    per table; `check=False` leaves it out for files known to be right.
    """
    tables = {}
    for name in names:
        if name not in SCHEMAS:
            raise ValueError(f"unknown table {name!r}; known: {sorted(SCHEMAS)}")
        path = table_path(folder, name)
        if check:
            check_schema(spark.read.parquet(path).schema, SCHEMAS[name], path)
        tables[name] = spark.read.schema(SCHEMAS[name]).parquet(path)
    return tables
