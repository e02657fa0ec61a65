"""Calendar helpers for `timestamp_ntz` columns.

Everything goes through `date`, which has no time zone, so the result does not
depend on `spark.sql.session.timeZone`.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("day", "week", "month")


def day_of(moment: Column) -> Column:
    return moment.cast("date")


def period_start(moment: Column, unit: str) -> Column:
    """First midnight of the day, week (from Monday) or month of `moment`."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    day = day_of(moment)
    start = day if unit == "day" else F.trunc(day, unit)
    return start.cast("timestamp_ntz")


def as_moment(value: str | date | datetime) -> Column:
    """A `timestamp_ntz` literal that the optimizer folds and can push down."""
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def as_day(value: str | date | datetime) -> Column:
    return as_moment(value).cast("date")
