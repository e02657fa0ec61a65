"""Typed values out of JSON text, good and bad."""

import pytest

from tidepath.operators import json_scalars

TEXTS = {
    1: '{"k": 5, "in": {"list": [1, "two"]}}',
    2: '{"k": "7"}',
    3: '{"k": "x"}',
    4: '{"k": null}',
    5: "[]",
    6: '{"k": 1',
    7: "",
    8: None,
    9: '{"k": 1, "k": 2}',
    10: '{"k": 2.5, "in": {"list": [0, true]}}',
    11: "3",
    12: '{"k": 99999999999999999999}',
}


def test_json_scalars(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    fields = {"k": ("$.k", "long"), "second": ("$.in.list[1]", "string"), "whole": ("$", "int")}
    found = {row.id: tuple(row)[2:] for row in json_scalars(docs, "t", fields).collect()}
    assert len(found) == len(TEXTS)
    assert found[1] == (5, "two", None, "ok")
    assert found[2] == (7, None, None, "ok")
    for number in (3, 4, 5, 12):
        assert found[number] == (None, None, None, "ok")
    for number in (6, 7, 9):
        assert found[number] == (None, None, None, "malformed")
    assert found[8] == (None, None, None, "null")
    assert found[10][1:] == ("true", None, "ok")
    assert found[11] == (None, None, 3, "ok")
    assert json_scalars(docs.limit(0), "t", fields).count() == 0


def test_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "{}", "")], "id long, t string, t_state string")
    with pytest.raises(ValueError, match="t_state"):
        json_scalars(docs, "t", {"k": ("$.k", "long")})
