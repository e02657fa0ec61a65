"""As-of joins and points in intervals against plain Python, with ties, gaps and nulls."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import plan_of

from tidepath.operators import asof_join, points_in_intervals, sessions

START = datetime(2024, 3, 1)
LEFT = "id long, who long, at timestamp_ntz, r string"
RIGHT = "key long, t timestamp_ntz, n long"


def hours(x):
    return None if x is None else START + timedelta(hours=x)


def expected(lefts, rights, strict):
    found = {}
    for number, who, at in lefts:
        before = [
            (t, n)
            for key, t, n in rights
            if None not in (key, t, who, at) and key == who and (t < at if strict else t <= at)
        ]
        found[number] = max(before, default=(None, None))
    return found


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("unit", ["day", "week", "month"])
def test_last_row_before(spark, strict, unit):
    random.seed(4)
    who = [None, 1, 1, 1, 1, 2, 3, 4]
    lefts = [(i, random.choice(who), random.choice([None, *range(0, 2000, 7)])) for i in range(300)]
    rights = [(random.choice(who), random.choice([None, *range(0, 2000, 14)]), i) for i in range(150)]
    # Key 4 has rows on the right only long before and long after those on the left.
    rights = [r for r in rights if r[0] != 4] + [(4, -900, 7), (4, 9000, 8)]
    left = spark.createDataFrame([(i, w, hours(h), "x") for i, w, h in lefts], LEFT)
    right = spark.createDataFrame([(k, hours(t), n) for k, t, n in rights], RIGHT)
    joined = asof_join(
        left, right, {"who": "key"}, "at", "t", {"then": "t", "n": "n"}, order=("n",), strict=strict, unit=unit
    )
    assert joined.columns == ["id", "who", "at", "r", "then", "n"]
    rows = joined.collect()
    assert len(rows) == len(lefts)
    wanted = expected(lefts, rights, strict)
    assert {r.id: (r.then, r.n) for r in rows} == {i: (hours(t), n) for i, (t, n) in wanted.items()}
    assert any(t is None for t, _ in wanted.values()) and any(t is not None for t, _ in wanted.values())


def test_asof_of_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 1, hours(0), "x")], LEFT)
    right = spark.createDataFrame([(1, hours(0), 5)], RIGHT)
    ask = lambda a, b: asof_join(a, b, {"who": "key"}, "at", "t", {"n": "n"}).collect()
    assert ask(left.limit(0), right) == [] and ask(left, right.limit(0))[0].n is None
    assert ask(left.unionAll(left), right.unionAll(right)) == ask(left, right) * 2
    with pytest.raises(ValueError, match="rename"):
        asof_join(left, right, {"who": "key"}, "at", "t", {"R": "n"})


def test_a_hot_key_is_dealt_out_by_unit_and_the_large_side_moves_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(20_000).selectExpr(
            "id", "1L as who", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as at"
        )
        right = rows.selectExpr("who as key", "at as t", "id as n").where("n % 10 = 0")
        joined = asof_join(rows, right, {"who": "key"}, "at", "t", {"n": "n"})
        assert joined.where("n <> id - id % 10 or n is null").count() == 0
        plan = plan_of(joined).split("== Physical Plan ==")[1]
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        assert "hashpartitioning(_k0" in plan and "_unit" in plan.split("hashpartitioning(_k0")[1][:40]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SPANS = "s long, e long, tag string, k long"


@pytest.mark.parametrize("keyed", [False, True])
def test_points_in_intervals_of_all_lengths(spark, keyed):
    random.seed(8)
    spans = []
    for i in range(120):
        begin = random.randrange(-5_000, 5_000)
        spans.append((begin, begin + random.choice([-3, 0, 1, 2, 3, 4, 5, 16, 17, 400, 9_000]), f"i{i}", i % 3))
    spans += [(None, 5, "n", 1), (1, None, "n", 1), (-(2**40), 2**40, "long", 2), spans[5], spans[5]]
    spots = [(random.randrange(-5_500, 5_500), random.choice([0, 1, 2, None])) for _ in range(300)] + [(None, 1)]
    points = spark.createDataFrame([(x, g, 1) for x, g in spots], "x long, g long, _other int")
    intervals = spark.createDataFrame(spans, SPANS)
    on = [("g", "k")] if keyed else []
    found = points_in_intervals(points, intervals, "x", "s", "e", on)
    assert found.columns == ["x", "g", "_other", "s", "e", "tag", "k"]
    wanted = sorted(
        (x, g is None, g or 0, tag)
        for x, g in spots
        for s, e, tag, k in spans
        if None not in (x, s, e) and s <= x < e and (not keyed or g == k)
    )
    assert sorted((r.x, r.g is None, r.g or 0, r.tag) for r in found.collect()) == wanted
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert points_in_intervals(points, intervals.limit(0), "x", "s", "e").collect() == []
    assert points_in_intervals(points.limit(0), intervals, "x", "s", "e").collect() == []
    with pytest.raises(ValueError, match="rename"):
        points_in_intervals(points, intervals.withColumnRenamed("tag", "g"), "x", "s", "e")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_moments_do_not_depend_on_the_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The clocks of New York jump over 2:30 on this day.
        moments = [datetime(2024, 3, 10, h, m, 0, us) for h in (1, 2, 3) for m in (0, 30) for us in (0, 1)]
        events = spark.createDataFrame([(m, 1, "e") for m in moments], "ts timestamp_ntz, user_id long, kind string")
        spans = spark.createDataFrame([(moments[1], moments[6])], "a timestamp_ntz, b timestamp_ntz")
        inside = points_in_intervals(events, spans, "ts", "a", "b").collect()
        assert sorted(r.ts for r in inside) == moments[1:6]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sessions_cover_every_event(spark):
    rows = [(hours(h), 1 if h < 50 else 2, "e") for h in (0, 1, 6.9, 13, 30, 36, 60, 61)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, kind string")
    found = sessions(events, "6 hours")
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, hours(0), hours(12.9), 3), (1, hours(13), hours(19), 1),
        (1, hours(30), hours(42), 2), (2, hours(60), hours(67), 2),
    ]
