"""Sketches of days and paths: united over any window they stay within their error."""

from helpers import SMALL, plan_of
from pyspark.sql import functions as F

from tidepath.operators import daily_sketches, sketched_parties, sketched_quantiles, transfers_filtered
from tidepath.operators.sketches import relative_error
from tidepath.plans.views import load_transfers

MEDIUM = SMALL.replace("sf0.001", "sf0.01")


def test_any_window_is_within_the_error(spark):
    moves = load_transfers(spark, MEDIUM).cache()
    sketches = daily_sketches(moves).cache()
    assert sketches.count() == moves.select(F.to_date("sent_at"), "src", "dst").distinct().count()
    for start, end, src in ((None, None, None), ("1997-01-05", "1997-03-09", None), ("1995-06-01", None, "NATION_3")):
        exact = transfers_filtered(moves, start, end, src=src).agg(F.countDistinct("party")).first()[0]
        guess = sketched_parties(transfers_filtered(sketches, start, end, src=src)).first().approx_parties
        assert abs(guess - exact) <= 4 * relative_error() * exact + 1, (start, end, src)
    # A party of many days counts once: the sum of the days is far more than the union.
    days = sketched_parties(sketches, "sent_at").agg(F.sum("approx_parties")).first()[0]
    assert days > 5 * sketched_parties(sketches).first().approx_parties


def test_quantiles_keep_their_ranks(spark):
    moves = load_transfers(spark, MEDIUM).cache()
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    amounts = sorted(float(r.amount) for r in moves.select("amount").collect())
    (found,) = sketched_quantiles(daily_sketches(moves), probs).collect()
    for p, q in zip(probs, found.quantiles):
        rank = sum(a <= q for a in amounts) / len(amounts)
        assert abs(rank - p) < 0.02


def test_nulls_and_nothing(spark, moves):
    some = moves(
        ("2024-01-01T01:00", None, "a", "b", "5.00"), ("2024-01-01T02:00", 7, "a", "b", None),
        ("2024-01-02T02:00", 7, "a", "b", "9.00"), ("2024-01-02T02:00", None, "c", None, None),
    )
    sketches = daily_sketches(some)
    by_src = {r.src: r.approx_parties for r in sketched_parties(sketches, "src").collect()}
    assert by_src == {"a": 1, "c": 0}
    quantiles = {r.src: r.quantiles for r in sketched_quantiles(sketches, (0.0, 1.0), "src").collect()}
    assert quantiles == {"a": [5.0, 9.0], "c": None}
    assert daily_sketches(some.limit(0)).collect() == []
    assert sketched_parties(daily_sketches(some.limit(0)), "src").collect() == []


def test_tasks_send_sketches_not_transfers(spark):
    plan = plan_of(sketched_parties(daily_sketches(load_transfers(spark, SMALL)), "src"))
    assert "partial_hll_sketch_agg" in plan and "partial_hll_union_agg" in plan
