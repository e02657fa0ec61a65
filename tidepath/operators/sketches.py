"""Mergeable sketches by day and path, so that counts over any window need no second scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.functions.periods import period_start

# 2**12 registers: a relative standard error of about 1.04 / 64, or 1.7 %.
LOG_REGISTERS = 12
# Items a quantile sketch keeps at each level; ranks are then off by under 1 % as a rule.
SKETCH_ITEMS = 400


def relative_error(log_registers: int = LOG_REGISTERS) -> float:
    """The standard deviation of an estimated number of parties, relative to the number."""
    return 1.04 / 2 ** (log_registers / 2)


def daily_sketches(moves: DataFrame, log_registers: int = LOG_REGISTERS, items: int = SKETCH_ITEMS) -> DataFrame:
    """`sent_at` (the day), `src`, `dst`, with sketches `parties` and `amounts`.

    A row for each day and path, however many transfers there are; tasks send sketches,
    not transfers. Null parties and amounts are in no sketch.
    """
    return moves.groupBy(period_start(F.col("sent_at"), "day").alias("sent_at"), "src", "dst").agg(
        F.hll_sketch_agg("party", F.lit(log_registers)).alias("parties"),
        F.kll_sketch_agg_double(F.col("amount").cast("double"), F.lit(items)).alias("amounts"),
    )


def sketched_parties(sketches: DataFrame, *keys: Column | str) -> DataFrame:
    """Estimated number of different parties by `keys`, from `daily_sketches` or a part of it.

    Sketches are united, so a party of several days or paths counts once.
    """
    united = F.hll_sketch_estimate(F.hll_union_agg("parties")).alias("approx_parties")
    return sketches.groupBy(*keys).agg(united)


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], *keys: Column | str) -> DataFrame:
    """Estimated quantiles of the amounts by `keys` as `quantiles`, in the order of `probs`.

    Null where there is no amount.
    """
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("amounts").alias("merged"))
    wanted = F.array(*(F.lit(float(p)) for p in probs))
    some = F.kll_sketch_get_n_double("merged") > 0
    quantiles = F.when(some, F.kll_sketch_get_quantile_double("merged", wanted)).alias("quantiles")
    return merged.select(*(c for c in merged.columns if c != "merged"), quantiles)
