from types import SimpleNamespace

import pytest
from helpers import SMALL, rows_of
from pyspark.sql import functions as F

from tidepath.operators import transfers
from tidepath.plans.views import load_transfers
from tidepath.session import new_work_path
from tidepath.sources import SCHEMAS, read_tables, read_warehouse, write_overview


def test_every_table_has_its_schema(spark):
    for name, frame in read_tables(spark, SMALL, SCHEMAS).items():
        assert frame.schema == SCHEMAS[name]


def test_wrong_files_are_refused(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("r_regionkey")).write.parquet(
        str(tmp_path / "region.parquet")
    )
    with pytest.raises(ValueError, match="r_regionkey: expected int, found bigint; r_name"):
        read_tables(spark, str(tmp_path), ("region",))
    with pytest.raises(ValueError, match="unknown table"):
        read_tables(spark, SMALL, ("part",))


def test_write_by_month_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    monthly = (
        load_transfers(spark, SMALL)
        .groupBy(F.date_format("sent_at", "yyyy-MM").alias("month"), "src", "dst")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume"))
    )
    write_overview(monthly, path, ("month",))
    stored = spark.read.schema(monthly.schema).parquet(path)
    assert rows_of(stored, *monthly.columns) == rows_of(monthly)
    one = stored.where("month = '2000-03'")
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString()
    assert 0 < one.count() < stored.count()


def test_replacing_one_folder_or_all(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda *rows: spark.createDataFrame(list(rows), "month string, n int")
    write_overview(frame(("a", 1), ("b", 2)), path, ("month",))
    write_overview(frame(("b", 3)), path, ("month",), replace="touched")
    assert rows_of(spark.read.parquet(path), "month", "n") == [("a", 1), ("b", 3)]
    write_overview(frame(("c", 4)), path, ("month",))
    assert rows_of(spark.read.parquet(path), "month", "n") == [("c", 4)]
    with pytest.raises(ValueError):
        write_overview(frame(("c", 4)), path, replace="some")


def test_write_without_folders(spark, tmp_path):
    path = str(tmp_path / "flat")
    write_overview(spark.range(10), path)
    assert spark.read.parquet(path).count() == 10


class FakeReader:
    """Stands in for a JDBC source, which needs a database to talk to."""

    def __init__(self, frame):
        self.frame, self.seen = frame, {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **given):
        self.seen.update(given)
        return self

    def load(self):
        return self.frame


def test_warehouse_read_is_split_and_typed(spark):
    upper_case = read_tables(spark, SMALL, ("orders",))["orders"].toDF(
        *(name.upper() for name in SCHEMAS["orders"].names)
    )
    reader = FakeReader(upper_case.withColumn("EXTRA", F.lit(1)))
    found = read_warehouse(
        SimpleNamespace(read=reader),
        "jdbc:somewhere",
        "orders",
        table="SALES.ORDERS",
        partition_column="o_orderkey",
        lower_bound="0",
        upper_bound="1500",
        num_partitions=8,
        options={"user": "me"},
    )
    assert found.schema == SCHEMAS["orders"]
    assert reader.seen["format"] == "jdbc"
    assert reader.seen["dbtable"] == "SALES.ORDERS"
    assert reader.seen["partitionColumn"] == "o_orderkey"
    assert reader.seen["numPartitions"] == "8"
    assert reader.seen["user"] == "me"
    assert "o_orderdate timestamp_ntz" in reader.seen["customSchema"]
    with pytest.raises(ValueError):
        read_warehouse(
            SimpleNamespace(read=FakeReader(spark.range(1))),
            "jdbc:somewhere",
            "orders",
            partition_column="o_orderkey",
            lower_bound="0",
            upper_bound="1",
            num_partitions=1,
        )


@pytest.mark.parametrize("rows, marked", [(25, True), (24, False), (0, False)])
def test_small_warehouse_lookups_are_broadcast(spark, rows, marked):
    nation = read_warehouse(
        SimpleNamespace(read=FakeReader(read_tables(spark, SMALL, ("nation",))["nation"])),
        "jdbc:somewhere",
        "nation",
        partition_column="n_nationkey",
        lower_bound="0",
        upper_bound="25",
        num_partitions=1,
        broadcast_rows=rows,
    )
    assert ("ResolvedHint" in nation._jdf.queryExecution().analyzed().toString()) == marked
    tables = read_tables(spark, SMALL) | {"nation": nation}
    assert transfers(tables).count() == 5765


def test_work_path_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = new_work_path(spark, "x"), new_work_path(spark, "x")
    assert first.startswith(shared + "/x-") and first != second


def test_work_path_without_a_shared_folder():
    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default="/warehouse": default),
            sparkContext=SimpleNamespace(master=master),
        )

    assert new_work_path(session("local[2]"), "x").startswith("/warehouse/tidepath-work/x-")
    with pytest.raises(ValueError):
        new_work_path(session("yarn"), "x")
