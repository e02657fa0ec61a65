"""Partners, bags, versions and groupings against brute force."""

import random
import re
from collections import Counter

import pytest
from helpers import plan_of, rows_of

from tidepath.operators import (
    bag_changes,
    bag_difference,
    bag_intersection,
    daily_cube,
    grouped_at_once,
    version_changes,
    with_partner,
)

LEFT, RIGHT = "id long, k string, m long", "k string, m long, other string"


def sides(spark, seed=1):
    rng = random.Random(seed)
    some = lambda *xs: rng.choice([*xs, None])
    left = [(i, some("a", "b", "c", "d"), some(1, 2)) for i in range(40)]
    right = [(some("a", "b", "x"), some(1, 3), "o") for _ in range(200)]
    return left, right, spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("bounds", [{}, {"most_keys": 3}, {"most_bytes": 4}])
def test_partners(spark, bounds):
    left, right, ours, theirs = sides(spark)
    keys = {(k, m) for k, m, _ in right if k is not None and m is not None}
    for partner in (True, False):
        found = with_partner(ours, theirs, {"k": "k", "m": "m"}, partner, **bounds)
        assert found.columns == ours.columns
        assert rows_of(found, "id") == [(i,) for i, k, m in left if ((k, m) in keys) is partner]
        # Keys are sent ahead within the bounds, and only then.
        assert ("ResolvedHint (strategy=broadcast)" in plan_of(found)) is (not bounds)


def test_partners_in_empty_tables(spark):
    left, _, ours, theirs = sides(spark)
    assert with_partner(ours, theirs.limit(0), {"k": "k"}).count() == 0
    assert with_partner(ours, theirs.limit(0), {"k": "k"}, partner=False).count() == len(left)
    assert with_partner(ours.limit(0), theirs, {"k": "k"}, partner=False).count() == 0


def test_keys_go_ahead_of_the_shuffle(spark):
    left = spark.range(50).selectExpr("id AS k")
    right = spark.range(100_000).selectExpr("id % 5000 AS k")
    found = with_partner(left, right, {"k": "k"})
    found.collect()
    final = plan_of(found).split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    ahead = re.search(r"BroadcastHashJoin.*LeftSemi", final)
    assert ahead and "NestedLoop" not in final


@pytest.mark.parametrize("seed", range(3))
def test_bags(spark, seed):
    rng = random.Random(seed)

    def bag(n):
        return [(rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for _ in range(n)]

    left, right = bag(40), bag(30) + [("only", 1)]
    ours, theirs = (spark.createDataFrame(rows, "k string, m long") for rows in (left, right))
    a, b = Counter(left), Counter(right)
    rows = lambda df: Counter(tuple(row) for row in df.collect())
    assert rows(bag_difference(ours, theirs)) == a - b
    assert rows(bag_difference(ours, theirs)) == rows(ours.exceptAll(theirs))
    assert rows(bag_intersection(ours, theirs)) == a & b
    assert rows(bag_changes(ours, theirs)) == Counter(
        (*row, a[row], b[row]) for row in {*a, *b} if a[row] != b[row]
    )
    found = {row.k: tuple(row)[1:] for row in version_changes(ours, theirs, ("k",)).collect()}
    for key in {row[0] for row in {*a, *b}}:
        gone = sum(n for row, n in (a - b).items() if row[0] == key)
        come = sum(n for row, n in (b - a).items() if row[0] == key)
        kind = "removed" if not come else "added" if not gone else "changed"
        assert found.get(key) == ((kind, gone, come) if gone + come else None)


def test_bags_of_nothing_and_unlike_tables(spark):
    some = spark.createDataFrame([(1,), (1,)], "a long")
    assert bag_difference(some, some).count() == 0
    assert bag_difference(some, some.limit(0)).count() == 2
    assert bag_intersection(some.limit(0), some).count() == 0
    with pytest.raises(ValueError, match="same columns"):
        bag_difference(some, some.toDF("b"))
    with pytest.raises(ValueError, match="renamed"):
        bag_changes(some.toDF("n_left"), some.toDF("n_left"))


def test_groupings_from_one_sum(moves):
    table = moves(
        ("1996-01-01 10:00", 1, "A", "B", "1.50", "F"),
        ("1996-01-01 11:00", 2, "A", "B", "2.00", "O"),
        ("1996-01-02 10:00", 1, "A", None, "4.00", "F"),
        ("1996-01-03 10:00", 1, None, "B", None, None),
    )
    sets = (("src", "dst"), ("status",), ())
    found = grouped_at_once(table, sets)
    expected = [
        ("", None, None, None, 4, 7.5),
        ("src,dst", "A", "B", None, 2, 3.5),
        ("src,dst", "A", None, None, 1, 4.0),
        ("src,dst", None, "B", None, 1, None),
        ("status", None, None, "F", 2, 5.5),
        ("status", None, None, "O", 1, 2.0),
        ("status", None, None, None, 1, None),
    ]
    key = lambda row: tuple((v is None, v) for v in row)
    assert rows_of(found, "grouping", "src", "dst", "status", "n", "volume") == sorted(expected, key=key)
    assert rows_of(grouped_at_once(daily_cube(table), (("src",), ()))) == rows_of(
        grouped_at_once(table, (("src",), ()))
    )
    # The sets are spread over sums, not over transfers.
    plan = plan_of(found).split("== Physical Plan ==")[1]
    assert plan.index("Expand") < plan.rindex("HashAggregate")
    assert grouped_at_once(table.limit(0), (("src",),)).count() == 0
    for wrong in ((), (("src",), ("src",))):
        with pytest.raises(ValueError, match="set of columns"):
            grouped_at_once(table, wrong)
