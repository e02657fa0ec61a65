from datetime import date, datetime

from helpers import SMALL, plan_of, rows_of

from tidepath import operators as ops
from tidepath.plans.overview_job import (
    FROM_CUBE,
    FROM_TRANSFERS,
    store_transfers,
    stored_transfers,
    whole_months,
    write_overview_tables,
)
from tidepath.plans.views import load_transfers


def test_job_stores_what_the_operators_give(spark, tmp_path):
    target = str(tmp_path / "overview")
    names = write_overview_tables(
        spark, SMALL, target, "1997-05-01", "1998-02-15", replace="all"
    )
    assert {"region_subtotals", "path_counts", "size_bands"} < set(names)
    moves = ops.transfers_filtered(load_transfers(spark, SMALL), "1997-05-01", "1998-02-15")
    for name, operator in {**FROM_CUBE, **FROM_TRANSFERS}.items():
        assert rows_of(spark.read.parquet(f"{target}/{name}")) == rows_of(operator(moves)), name
    total = ops.totals(moves).first()
    regions = spark.read.parquet(f"{target}/region_subtotals")
    assert rows_of(regions.where("region is null"), "n", "volume") == [
        (total.n, float(total.volume))
    ]
    assert sum(row.n for row in spark.read.parquet(f"{target}/size_bands").collect()) == total.n
    matrix = spark.read.parquet(f"{target}/path_counts")
    assert sum(sum(row.n_by_dst.values()) for row in matrix.collect()) == total.n
    # A refresh from the middle of a month to that of another keeps all other rows.
    write_overview_tables(spark, SMALL, target, "1998-01-10", "1998-03-15")
    longer = ops.transfers_filtered(load_transfers(spark, SMALL), "1997-05-01", "1998-04-01")
    assert rows_of(spark.read.parquet(f"{target}/totals")) == rows_of(ops.totals(longer))


def test_windows_become_whole_months():
    assert whole_months("1998-03-15", datetime(1998, 12, 2)) == (date(1998, 3, 1), date(1999, 1, 1))
    assert whole_months(date(1998, 3, 1), "1998-04-01") == (date(1998, 3, 1), date(1998, 4, 1))
    assert whole_months(None, None) == (None, None)


def test_stored_months_are_pruned_and_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "transfers")
    moves = load_transfers(spark, SMALL)
    store_transfers(moves, path)
    assert rows_of(ops.totals(stored_transfers(spark, path))) == rows_of(ops.totals(moves))
    kept = stored_transfers(spark, path, "1998-03-10", "1998-04-01")
    expected = ops.transfers_filtered(moves, "1998-03-10", "1998-04-01")
    assert rows_of(ops.totals(kept)) == rows_of(ops.totals(expected))
    assert "(month#" in plan_of(kept).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    march = ops.transfers_filtered(moves, "1998-03-01", "1998-04-01")
    store_transfers(march.limit(1), path, replace="touched")
    left = ops.totals(stored_transfers(spark, path)).first().n
    assert left == ops.totals(moves).first().n - march.count() + 1


def test_a_refresh_empties_months_that_lost_their_transfers(spark, tmp_path):
    path = str(tmp_path / "some transfers")
    moves = load_transfers(spark, SMALL)
    store_transfers(moves, path)
    window = ("1998-02-01", "1998-05-01")
    left = ops.transfers_filtered(moves, *window).where("month(sent_at) <> 3")
    store_transfers(left, path, "touched", *window)
    rest = moves.where("sent_at < '1998-03-01' or sent_at >= '1998-04-01'")
    assert rows_of(ops.totals(stored_transfers(spark, path))) == rows_of(ops.totals(rest))
    # Nothing left in the window at all, and a target that does not exist yet.
    store_transfers(left.limit(0), path, "touched", *window)
    rest = moves.where("sent_at < '1998-02-01' or sent_at >= '1998-05-01'")
    assert rows_of(ops.totals(stored_transfers(spark, path))) == rows_of(ops.totals(rest))
    store_transfers(left, str(tmp_path / "new"), "touched", *window)
    assert spark.read.parquet(str(tmp_path / "new")).count() == left.count()
