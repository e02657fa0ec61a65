"""Every named query against its SQL twin, and facts that hold at any size."""

import re
from collections import Counter

import duckdb
import pytest
from helpers import SMALL, plan_of, rows_of

import __spark_entry__ as contract
from tidepath.operators import cumulative, daily_zero_filled, net_flow, paths, totals
from tidepath.plans.oracle import ORACLE
from tidepath.plans.queries import QUERIES
from tidepath.plans.views import load_transfers
from tidepath.sources.tables import SCHEMAS

STREAMS = {"live_daily", "live_daily_open", "stream_dedupe", "user_sessions", "live_sessions", "clicks_before_purchases"}
TWO_TABLES = {"routes_lost", "route_changes"}  # compare two tables of transfers
BATCH = sorted(set(QUERIES) - STREAMS)


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def as_rows(table, names):
    return Counter(zip(*(table.column(name).to_pylist() for name in names)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, engine, name):
    ours = QUERIES[name](spark, SMALL).toArrow()
    theirs = engine.sql(ORACLE[name]).to_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    assert [ours.schema.field(n).type for n in names] == [theirs.schema.field(n).type for n in names]
    assert ours.num_rows > 0
    assert as_rows(ours, names) == as_rows(theirs, names)


def test_only_the_estimate_has_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"approx_parties"}


def test_the_contract_names_them_all():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


def test_entry(spark):
    assert rows_of(contract.entry(spark), "n", "volume", "parties", "paths") == [
        (5765, 305669503.72, 150, 240)
    ]


@pytest.mark.parametrize("name", BATCH)
def test_plans_stay_native_and_scan_once(spark, name):
    found = QUERIES[name](spark, SMALL)
    found.collect()
    plan = plan_of(found)
    final = plan[plan.index("== Physical Plan ==") :].split("== Initial Plan ==")[0]
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in final
    scans = 2 if name in TWO_TABLES else 1
    assert len(re.findall(r"FileScan parquet.*lineitem", final)) <= scans


def test_invariants(spark):
    moves = load_transfers(spark, SMALL)
    total = totals(moves).first()
    by_path = paths(moves).collect()
    assert sum(row.n for row in by_path) == total.n
    assert sum(row.volume for row in by_path) == total.volume
    assert abs(sum(row.share_pct for row in by_path) - 100) < 0.03
    assert sum(row.net for row in net_flow(moves).collect()) == 0
    assert max(row.cum_volume for row in cumulative(moves).collect()) == total.volume
    assert sum(row.n for row in daily_zero_filled(moves).collect()) == total.n
