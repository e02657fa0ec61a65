"""Flows between places, subtotals and the spread of amounts."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.measures import MONEY, side_column, transfer_count, volume
from tidepath.operators.overview import path_totals

# Amounts are split at 2**40 and at 2**20 cents to find a quantile. With 18 digits
# no level has more than 2**20 ranges or distinct amounts in a group to sort,
# whatever the number of transfers.
COARSE_BITS, FINE_BITS = 40, 20
NULL_BUCKET = -(2**63)


def net_flow(moves: DataFrame) -> DataFrame:
    """Volume out, volume in and the difference, for each place.

    Paths are summed first, so each transfer is read once and only summed paths
    are written out to both sides.
    """
    nothing = F.lit(0).cast(MONEY)
    ends = F.array(
        F.struct(
            F.col("src").alias("place"),
            F.col("volume").alias("out_volume"),
            nothing.alias("in_volume"),
        ),
        F.struct(
            F.col("dst").alias("place"),
            nothing.alias("out_volume"),
            F.col("volume").alias("in_volume"),
        ),
    )
    sides = path_totals(moves).select(F.inline(ends))
    both = sides.groupBy("place").agg(
        F.sum("out_volume").cast(MONEY).alias("out_volume"),
        F.sum("in_volume").cast(MONEY).alias("in_volume"),
    )
    return both.withColumn("net", (F.col("in_volume") - F.col("out_volume")).cast(MONEY))


def region_subtotals(
    moves: DataFrame, nation: DataFrame, region: DataFrame, side: str = "src"
) -> DataFrame:
    """Number and volume by place, by region, and in all, each told by `level`.

    `level` is `place`, `region` or `all`: a place without a region, or no place,
    keeps its rows and has null there, as subtotals do. Places are summed before
    the lookups and the rollup, which then see one row per place.
    """
    by_side = moves.groupBy(side_column(side).alias("n_name")).agg(
        transfer_count(moves), volume(moves)
    )
    homes = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy("n_name")
        .agg(F.min("r_name").alias("r_name"))
    )
    level = F.element_at(
        F.array(F.lit("place"), F.lit("region"), F.lit("all")),
        F.bit_count(F.grouping_id()) + 1,
    )
    return (
        by_side.join(homes, "n_name", "left")
        .rollup(F.col("r_name").alias("region"), F.col("n_name").alias("place"))
        .agg(
            F.sum("n").alias("n"),
            F.sum("volume").cast(MONEY).alias("volume"),
            level.alias("level"),
        )
        .select("level", "region", "place", "n", "volume")
    )


def path_matrix(moves: DataFrame, places: Sequence[str]) -> DataFrame:
    """Number of transfers: a row per source, a column per place in `places`.

    The list is given, so Spark need not scan the transfers to find the columns.
    """
    counts = moves.groupBy("src").pivot("dst", list(places)).agg(transfer_count(moves))
    filled = [F.coalesce(counts[f"`{place}`"], F.lit(0)).alias(place) for place in places]
    return counts.select("src", *filled)


def path_counts(moves: DataFrame) -> DataFrame:
    """Number of transfers per source, as one map from destination to number.

    The same facts as `path_matrix` in a form whose columns do not depend on the
    places, so any number of places fits. Paths are counted first.
    """
    entry = F.struct(F.col("dst").alias("key"), F.col("n").alias("value"))
    return (
        path_totals(moves)
        .where(F.col("dst").isNotNull())
        .groupBy("src")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("n_by_dst"))
    )


def size_bands(
    moves: DataFrame,
    edges: Sequence[str | int | Decimal],
    names: Sequence[str] = ("small", "middle", "large"),
) -> DataFrame:
    """Number and volume in bands of amount; an edge belongs to the upper band."""
    limits = [Decimal(str(edge)) for edge in edges]
    if len(names) != len(limits) + 1 or limits != sorted(set(limits)):
        raise ValueError("edges must ascend, and names must be one more than edges")
    amount = F.col("amount")
    band = F.when(amount < F.lit(limits[0]), names[0])
    for limit, name in zip(limits[1:], names[1:-1]):
        band = band.when(amount < F.lit(limit), name)
    band = band.when(amount.isNotNull(), names[-1])
    return moves.groupBy(band.alias("band")).agg(transfer_count(moves), volume(moves))


def quantile_name(prob: float) -> str:
    return "p" + f"{prob * 100:g}".replace(".", "_")


def amount_quantiles(
    moves: DataFrame, probs: Sequence[float] = (0.5, 0.95), accuracy: int | None = None
) -> DataFrame:
    """Quantiles of the amount for each source, interpolated and rounded to 4.

    The built-in exact percentile keeps all distinct amounts of a source in one
    task. Here a source is cut into ranges of amounts, the ranges are counted to
    see which hold the wanted ranks, only those are cut into finer ranges, and at
    last the amounts of the finer ones are sorted, each range on its own.
    With `accuracy`, Spark's approximate percentile is used instead.
    """
    if not probs or any(not 0 <= prob <= 1 for prob in probs):
        raise ValueError("probs must be between 0 and 1")
    if accuracy is not None:
        return moves.groupBy("src").agg(
            *(
                F.percentile_approx("amount", prob, accuracy)
                .cast("double")
                .alias(quantile_name(prob))
                for prob in probs
            )
        )
    cents = (F.col("amount") * 100).cast("bigint")
    # Null amounts get a range of their own, so that both uses of this frame
    # need the same rows and Spark computes it once.
    amounts = (
        moves.groupBy("src", cents.alias("cents"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                name: F.coalesce(F.shiftright("cents", bits), F.lit(NULL_BUCKET))
                for name, bits in (("coarse", COARSE_BITS), ("bucket", FINE_BITS))
            }
        )
    )
    fine = amounts.groupBy("src", "coarse", "bucket").agg(
        F.sum(F.when(F.col("cents").isNull(), 0).otherwise(F.col("n"))).alias("held")
    )
    hits = _ranges_with_ranks(fine, probs)
    return _pick_ranks(amounts, hits, probs)


def _rank_position(prob: float, total: Column) -> Column:
    return F.lit(float(prob)) * (total - 1)


def _ranks_inside(ranks: Column) -> Column:
    return F.filter(
        ranks,
        lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("held")),
    )


def _ranges_with_ranks(fine: DataFrame, probs: Sequence[float]) -> DataFrame:
    """For each source, the fine ranges that hold a wanted rank (counted from 0).

    The range of null amounts counts 0 rows and is kept, so that a source with
    nothing else keeps its row in the result.
    """
    source = Window.partitionBy("src")
    upto = Window.unboundedPreceding, Window.currentRow
    coarse = (
        fine.groupBy("src", "coarse")
        .agg(F.sum("held").alias("held"))
        .select(
            F.col("src").alias("hit_src"),
            F.col("coarse").alias("hit_coarse"),
            "held",
            (F.sum("held").over(source.orderBy("coarse").rowsBetween(*upto)) - F.col("held")).alias(
                "before"
            ),
            F.sum("held").over(source).alias("total"),
        )
    )
    wanted = F.array_distinct(
        F.array(
            *(
                step(_rank_position(prob, F.col("total")))
                for prob in probs
                for step in (F.floor, F.ceil)
            )
        )
    )
    open_ranges = (
        coarse.withColumn("ranks", _ranks_inside(wanted))
        .where((F.size("ranks") > 0) | (F.col("hit_coarse") == NULL_BUCKET))
        .select("hit_src", "hit_coarse", F.col("before").alias("start"), "total", "ranks")
    )
    within = Window.partitionBy("src", "coarse").orderBy("bucket").rowsBetween(*upto)
    same_range = F.col("src").eqNullSafe(F.col("hit_src")) & (
        F.col("coarse") == F.col("hit_coarse")
    )
    return (
        fine.join(open_ranges, same_range)
        .withColumn("before", F.col("start") + F.sum("held").over(within) - F.col("held"))
        .withColumn("ranks", _ranks_inside(F.col("ranks")))
        .where((F.size("ranks") > 0) | (F.col("bucket") == NULL_BUCKET))
        .select(
            F.col("src").alias("hit_src"),
            F.col("bucket").alias("hit_bucket"),
            "before",
            "total",
            "ranks",
        )
    )


def _pick_ranks(amounts: DataFrame, hits: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The amounts at the wanted ranks, interpolated for each source."""
    so_far = (
        Window.partitionBy("src", "bucket")
        .orderBy("cents")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same_range = F.col("src").eqNullSafe(F.col("hit_src")) & (
        F.col("bucket") == F.col("hit_bucket")
    )
    upto = F.col("upto")
    picked = (
        amounts.join(hits, same_range)
        .withColumn("upto", F.col("before") + F.sum("n").over(so_far))
        .select(
            "src",
            "total",
            (F.col("cents").cast("double") / 100).alias("amount"),
            F.explode_outer(
                F.filter("ranks", lambda rank: (rank < upto) & (rank >= upto - F.col("n")))
            ).alias("rank"),
        )
    )

    def quantile(prob: float) -> Column:
        position = _rank_position(prob, F.col("total"))
        low = F.max(F.when(F.col("rank") == F.floor(position), F.col("amount")))
        high = F.max(F.when(F.col("rank") == F.ceil(position), F.col("amount")))
        part = F.max(position - F.floor(position))
        return F.round(low + (high - low) * part, 4).alias(quantile_name(prob))

    return picked.groupBy("src").agg(*(quantile(prob) for prob in probs))
