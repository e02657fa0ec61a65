"""Typed values out of JSON text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_scalars(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """`df` with a typed column for each of `fields`, and `<column>_state`.

    `fields` maps a new name to a path such as `$.a.b[0]` and a Spark type. The text is
    parsed once, to a variant. The state is `ok`, `null` for a null text, or `malformed`
    for one that is not JSON (an empty one, or an object that has a key twice). A value is
    null if the text is not `ok`, if nothing is at the path, or if what is there cannot be
    the type; text that reads as a number can.
    """
    state = f"{column}_state"
    both = {name.lower() for name in df.columns} & {name.lower() for name in (*fields, state)}
    if both:
        raise ValueError(f"columns named {sorted(both)} are there already")
    # A generator, so that a text is parsed once for all fields.
    parsed = df.select("*", F.explode(F.array(F.try_parse_json(column))).alias("_parsed"))
    told = (
        F.when(F.col(column).isNull(), "null").when(F.col("_parsed").isNull(), "malformed").otherwise("ok")
    )
    return parsed.select(
        *df.columns,
        *(F.try_variant_get("_parsed", path, kind).alias(name) for name, (path, kind) in fields.items()),
        told.alias(state),
    )
