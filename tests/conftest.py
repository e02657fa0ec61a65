from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepath.session import build_session  # noqa: E402

TRANSFERS = T.StructType(
    [
        T.StructField(
            "transfer_key",
            T.StructType(
                [T.StructField("order", T.LongType()), T.StructField("line", T.IntegerType())]
            ),
        ),
        T.StructField("sent_at", T.TimestampNTZType()),
        T.StructField("party", T.LongType()),
        T.StructField("asset", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("amount", T.DecimalType(18, 2)),
    ]
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app_name="tests",
        master="local[8]",
        shuffle_partitions=4,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def moves(spark):
    """Build a transfers table from short rows: (when, party, src, dst, amount, status)."""

    def build(*rows):
        full = []
        for number, row in enumerate(rows):
            when, party, src, dst, amount, status = (*row, "F")[:6]
            full.append(
                (
                    (number, 1),
                    None if when is None else datetime.fromisoformat(when),
                    party,
                    number % 3,
                    src,
                    dst,
                    status,
                    None if amount is None else Decimal(amount),
                )
            )
        return spark.createDataFrame(full, TRANSFERS)

    return build
