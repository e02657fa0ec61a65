import pytest
from helpers import rows_of

from tidepath.operators import by_period, by_place, paths, top_paths_per_period, totals


@pytest.fixture
def null_fields(moves):
    return moves(
        ("2000-01-01", 1, "a", "b", "10.00", "F"),
        ("2000-01-01", None, "a", "b", "20.00", "F"),
        ("2000-01-01", 2, "a", "b", None, None),
        ("2000-01-01", 2, None, "b", "40.00", "F"),
    )


def test_totals(null_fields):
    assert rows_of(totals(null_fields)) == [(4, 70.0, 2, 1, 40.0)]


def test_totals_of_nothing(moves):
    assert rows_of(totals(moves())) == [(0, None, 0, 0, None)]


def test_large_sums_are_exact(moves):
    top = "9999999999999999.99"
    found = totals(moves(*[("2000-01-01", 1, "a", "b", top)] * 3)).first()
    assert str(found.volume) == "29999999999999999.97"
    assert str(found.max_amount) == top


def test_period_edges(moves):
    found = moves(
        ("2000-01-31T23:59:59.999999", 1, "a", "b", "1"),
        ("2000-02-01", 1, "a", "b", "2"),
        ("2000-02-06T23:59:59", 1, "a", "b", "4"),
        ("2000-02-07", 1, "a", "b", "8"),
        (None, 1, "a", "b", "16"),
    )
    assert rows_of(by_period(found, "month")) == [
        ("2000-01-01", 1, 1.0),
        ("2000-02-01", 3, 14.0),
        (None, 1, 16.0),
    ]
    # 31 January 2000 and 7 February 2000 are Mondays.
    assert rows_of(by_period(found, "week")) == [
        ("2000-01-31", 3, 7.0),
        ("2000-02-07", 1, 8.0),
        (None, 1, 16.0),
    ]
    assert len(rows_of(by_period(found, "day"))) == 5
    with pytest.raises(ValueError):
        by_period(found, "year")


def test_places(null_fields):
    assert rows_of(by_place(null_fields, "src")) == [("a", 3, 30.0, 2), (None, 1, 40.0, 1)]
    assert rows_of(by_place(null_fields, "dst")) == [("b", 4, 70.0, 2)]
    with pytest.raises(ValueError):
        by_place(null_fields, "status")


def test_paths(null_fields, moves):
    assert rows_of(paths(null_fields)) == [
        ("a", "b", 3, 30.0, 42.8571),
        (None, "b", 1, 40.0, 57.1429),
    ]
    assert rows_of(paths(moves())) == []
    assert rows_of(paths(moves(("2000-01-01", 1, "a", "b", "0")))) == [("a", "b", 1, 0.0, None)]


def test_top_paths_break_ties_by_name(moves):
    found = moves(
        ("2000-01-03", 1, "b", "a", "5"),
        ("2000-01-02", 1, "a", "c", "5"),
        ("2000-01-01", 1, "a", "b", "2"),
        ("2000-01-09", 1, "a", "b", "3"),
        ("2000-01-01", 1, "c", "a", "9"),
        ("2000-02-01", 1, "c", "a", "1"),
        ("2000-02-01", 1, "c", "b", None),
    )
    assert rows_of(top_paths_per_period(found, "month", 3), "period", "rank", "src", "dst") == [
        ("2000-01-01", 1, "c", "a"),
        ("2000-01-01", 2, "a", "b"),
        ("2000-01-01", 3, "a", "c"),
        ("2000-02-01", 1, "c", "a"),
        ("2000-02-01", 2, "c", "b"),
    ]
