"""What the tests share besides fixtures."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

SMALL = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    """The rows as sorted tuples; dates as text, decimals as float."""

    def plain(value):
        if isinstance(value, datetime):
            return value.isoformat(" ", "seconds") if value.time() != datetime.min.time() else str(value.date())
        return float(value) if isinstance(value, Decimal) else value

    names = columns or df.columns
    found = [tuple(plain(row[name]) for name in names) for row in df.collect()]
    return sorted(found, key=lambda row: tuple((value is None, value) for value in row))


def plan_of(df):
    return df._jdf.queryExecution().toString()
