import pytest
from helpers import rows_of

from tidepath.operators import (
    cumulative,
    daily_cube,
    daily_zero_filled,
    period_change,
    rank_places,
    rolling_7d,
)


@pytest.fixture
def gap_days(moves):
    return moves(
        ("2000-02-27T10:00:00", 1, "a", "b", "1"),
        ("2000-02-27T23:59:59.999999", 1, "a", "b", "2"),
        ("2000-03-02", 2, "a", "b", "4"),
        (None, 2, "a", "b", "8"),
    )


def test_zero_days_between_first_and_last(gap_days):
    expected = [
        ("2000-02-27", 2),
        ("2000-02-28", 0),
        ("2000-02-29", 0),
        ("2000-03-01", 0),
        ("2000-03-02", 1),
    ]
    assert rows_of(daily_zero_filled(gap_days)) == expected
    assert rows_of(daily_zero_filled(daily_cube(gap_days))) == expected


def test_zero_days_within_given_bounds(gap_days, moves):
    assert rows_of(daily_zero_filled(gap_days, "2000-02-26", "2000-02-27")) == [
        ("2000-02-26", 0),
        ("2000-02-27", 2),
    ]
    assert rows_of(daily_zero_filled(gap_days, start="2000-03-01")) == [
        ("2000-03-01", 0),
        ("2000-03-02", 1),
    ]
    assert rows_of(daily_zero_filled(gap_days, end="2000-02-28")) == [
        ("2000-02-27", 2),
        ("2000-02-28", 0),
    ]
    assert rows_of(daily_zero_filled(moves(), "2000-01-01", "2000-01-02")) == [
        ("2000-01-01", 0),
        ("2000-01-02", 0),
    ]
    assert rows_of(daily_zero_filled(moves())) == []


def test_cumulative(moves):
    found = moves(
        ("2000-03-05", 1, "a", "b", "4"),
        ("2000-01-05", 1, "a", "b", "1"),
        ("2000-01-06", 1, "a", "b", "2"),
    )
    assert rows_of(cumulative(found)) == [("2000-01-01", 3.0), ("2000-03-01", 7.0)]
    assert rows_of(cumulative(moves())) == []


def test_period_change(moves):
    found = moves(
        *[("2000-01-05", 1, "a", "b", "1")] * 3,
        *[("2000-02-05", 1, "a", "b", "1")] * 4,
        ("2000-04-05", 1, "a", "b", "1"),
    )
    assert rows_of(period_change(found)) == [
        ("2000-01-01", None, None),
        ("2000-02-01", 1, 33.3333),
        ("2000-04-01", -3, -75.0),
    ]


def test_rolling_seven_days(moves):
    found = moves(
        ("2000-01-01", 1, "a", "b", "1"),
        ("2000-01-07T23:00:00", 1, "a", "b", "1"),
        ("2000-01-08", 1, "a", "b", "1"),
        ("2000-01-08", 1, "a", "b", "1"),
        ("2000-02-01", 1, "a", "b", "1"),
    )
    assert rows_of(rolling_7d(found)) == [
        ("2000-01-01", 1),
        ("2000-01-07", 2),
        ("2000-01-08", 3),
        ("2000-02-01", 1),
    ]


def test_ranks_keep_ties(moves):
    found = moves(
        ("2000-01-01", 1, "a", "z", "5"),
        ("2000-01-01", 1, "b", "z", "5"),
        ("2000-01-01", 1, "c", "y", "9"),
        ("2000-01-01", 1, "d", "y", "1"),
    )
    assert rows_of(rank_places(found, "src"), "rank", "place") == [
        (1, "c"),
        (2, "a"),
        (2, "b"),
        (4, "d"),
    ]
    assert rows_of(rank_places(found, "dst"), "rank", "place") == [(1, "y"), (1, "z")]
