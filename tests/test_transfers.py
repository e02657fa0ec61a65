from datetime import datetime

import pytest
from helpers import SMALL, plan_of, rows_of

from tidepath.operators import daily_cube, paths, totals, transfers, transfers_filtered
from tidepath.plans.views import load_transfers, register_transfers
from tidepath.sources import read_tables
from tidepath.sources.tables import SCHEMAS


def base_tables(spark, lines):
    """Two nations, a supplier and a customer in each, one order per customer."""
    frame = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    when = datetime(2000, 3, 1, 12)
    return {
        "nation": frame("nation", [(1, "HERE", 0), (2, "THERE", 0)]),
        "supplier": frame("supplier", [(10, "s", 1, 0.0), (20, "s", 2, 0.0)]),
        "customer": frame("customer", [(100, "c", 1, 0.0, "m"), (200, "c", 2, 0.0, "m")]),
        "orders": frame(
            "orders", [(1, 100, "F", 0.0, when, "p"), (2, 200, "O", 0.0, when, "p")]
        ),
        "lineitem": frame(
            "lineitem",
            [
                (order, part, supplier, line, 1.0, price, 0.0, 0.0, "A", "F", when)
                for order, line, supplier, part, price in lines
            ],
        ),
    }


def test_same_place_is_dropped_and_sides_are_right(spark):
    tables = base_tables(spark, [(1, 1, 10, 7, 5.0), (1, 2, 20, 8, 6.25), (2, 1, 10, 9, 7.5)])
    found = transfers(tables)
    assert rows_of(found, "party", "asset", "src", "dst", "status", "amount") == [
        (100, 8, "THERE", "HERE", "F", 6.25),
        (200, 9, "HERE", "THERE", "O", 7.5),
    ]


def test_colliding_keys_are_both_kept(spark):
    tables = base_tables(spark, [(1, 1, 20, 7, 5.0), (1, 1, 20, 8, 6.0)])
    found = transfers(tables)
    assert rows_of(found, "asset") == [(7,), (8,)]
    assert {tuple(row.transfer_key) for row in found.collect()} == {(1, 1)}


def test_an_order_with_most_lines_is_whole(spark):
    lines = [(1, number, 20, number, 1.0) for number in range(2000)]
    lines += [(2, number, 10, number, 1.0) for number in range(1000)]
    assert rows_of(paths(transfers(base_tables(spark, lines))), "src", "n") == [
        ("HERE", 1000),
        ("THERE", 2000),
    ]


def test_period_bounds(moves):
    found = moves(
        ("2000-01-31T23:59:59.999999", 1, "a", "b", "1"),
        ("2000-02-01T00:00:00", 2, "a", "b", "1"),
        ("2000-02-29T23:59:59.999999", 3, "a", "b", "1"),
        ("2000-03-01T00:00:00", 4, "a", "b", "1"),
        (None, 5, "a", "b", "1"),
    )
    kept = transfers_filtered(found, "2000-02-01", datetime(2000, 3, 1))
    assert rows_of(kept, "party") == [(2,), (3,)]


def test_filters_on_one_or_several_values(moves):
    found = moves(
        ("2000-01-01", 1, "a", "b", "1", "F"),
        ("2000-01-01", 2, "b", "a", "1", "O"),
        ("2000-01-01", 3, "c", "a", "1", None),
        ("2000-01-01", 4, None, "a", "1", "P"),
    )
    assert rows_of(transfers_filtered(found, src=["a", "c"]), "party") == [(1,), (3,)]
    assert rows_of(transfers_filtered(found, dst="a", status=("O", "P")), "party") == [(2,), (4,)]
    assert rows_of(transfers_filtered(found, asset=0), "party") == [(1,), (4,)]
    assert rows_of(transfers_filtered(found), "party") == [(1,), (2,), (3,), (4,)]


def test_filters_reach_the_scans(spark):
    kept = transfers_filtered(load_transfers(spark, SMALL), "1998-01-01", "1999-01-01", src="NATION_3")
    plan = plan_of(kept)
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan
    assert "LessThan(o_orderdate,1999-01-01" in plan
    assert "EqualTo(n_name,NATION_3)" in plan
    # The lookup of the source sits below the sort-merge join of lines and orders.
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.index("SortMergeJoin") < physical.index("EqualTo(n_name,NATION_3)")
    assert physical.count("SortMergeJoin") == 1


def test_only_needed_columns_are_read(spark):
    plan = plan_of(load_transfers(spark, SMALL).groupBy("src").count())
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert "struct<l_orderkey:bigint,l_suppkey:bigint>" in schemas


def test_cube_gives_the_same_sums(spark):
    found = load_transfers(spark, SMALL)
    cube = daily_cube(found)
    assert rows_of(paths(cube)) == rows_of(paths(found))
    assert rows_of(cube.groupBy().sum("n"), "sum(n)") == rows_of(totals(found), "n")


def test_sql_over_the_view(spark):
    register_transfers(spark, SMALL)
    counted = spark.sql("select count(*) as n, count(distinct party) as parties from transfers")
    assert rows_of(counted) == [(5765, 150)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_cube_days_do_not_depend_on_the_time_zone(spark, moves, zone):
    found = moves(("2000-01-01T00:30:00", 1, "a", "b", "1"), ("2000-01-01T23:30:00", 1, "a", "b", "1"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert rows_of(daily_cube(found), "sent_at", "n") == [("2000-01-01", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_hot_order_is_split_over_tasks(spark, tmp_path):
    """A third of the lines in one order: the large join splits them, and loses none."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
        # Else whichever side is ready first may be broadcast, being small here.
        "spark.sql.autoBroadcastJoinThreshold": "20k",
    }
    tables = base_tables(spark, [])
    for name in ("nation", "supplier", "customer"):
        tables[name].write.parquet(f"{tmp_path}/{name}.parquet")
    tables = read_tables(spark, str(tmp_path), ("nation", "supplier", "customer"))
    ids = spark.range(0, 90_000, 1, 8)
    tables["lineitem"] = ids.selectExpr(
        "if(id % 3 = 0, 1, id) as l_orderkey",
        "id as l_partkey",
        "if(id % 2 = 0, 10L, 20L) as l_suppkey",
        "1 as l_linenumber",
        "1.0D as l_extendedprice",
    )
    tables["orders"] = spark.range(0, 90_000, 1, 8).selectExpr(
        "id as o_orderkey",
        "if(id % 2 = 0, 100L, 200L) as o_custkey",
        "'F' as o_orderstatus",
        "timestamp_ntz'2000-01-01' as o_orderdate",
    )
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = totals(transfers(tables))
        # Supplier and order are in different places where one is odd and one even.
        n = sum(1 for id in range(90_000) if id % 2 != (1 if id % 3 == 0 else id) % 2)
        assert rows_of(found, "n", "volume") == [(n, float(n))]
        assert "SortMergeJoin(skew=true)" in plan_of(found)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
