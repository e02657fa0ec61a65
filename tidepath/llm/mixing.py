"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.llm.common import stored

# White space between words, weights of the sources in order.
SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)

# The ranks of a source are cut into so many ranges; only the range that holds
# the cut is ordered row by row, and the rows of the others are in so many groups.
RANGES = 4096


def n_words(text: Column) -> Column:
    """Number of runs of other characters than white space; null has none."""
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}\\z", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, SPACE))
    ).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source its words and how many of them the mix should take.

    The sources share `share` times all words by weight. No target goes over
    `most` times the source's words; the excess is shared again by weight among
    the others. A source reaches its limit the sooner the smaller its limit is
    for its weight, so those at the limit are a prefix in that order, and one
    pass over the sources (one row each) finds them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    from_here = Window.orderBy(
        F.col("ratio").desc(), F.col("source").desc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(everything) * share)
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)) * most)
        .withColumn("weights_left", F.sum("weight").over(from_here))
        .withColumn("level", (F.col("whole") - F.col("capped")) / F.col("weights_left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * most)
        # The level of the first source that stays below its limit holds for all after it.
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct("ratio", "source", "level"))).over(everything))
    )
    limit = F.col("source_size") * float(most)
    free = F.col("final.level") * F.col("weight")
    return ranked.select(
        "source",
        "source_size",
        F.coalesce(F.least(limit, free), limit).cast("double").alias("target"),
    )


def inclusion(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """`_scaled, scale`: a document of `size` words is sampled with chance `scale / sqrt(size)`.

    The chance is 1 where that is more. The scale makes the expected words those that are
    left for the sample, so the chances are true probabilities; shorter documents are
    likelier, which spreads the words over more of them. The shortest are the ones of
    chance 1, a prefix by size, which one pass over the sizes of a source finds. `counts`
    has a row for each source and size, however many documents have it.
    """
    by_size = Window.partitionBy("_source").orderBy("size")
    shorter = by_size.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(shorter), F.lit(0))
    scale = left / F.sum(F.col("n") * F.sqrt("size")).over(from_here)
    return (
        counts.where("size > 0")
        .join(goals.where("rest > 0"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("scale", scale)
        .where(F.col("scale") <= F.sqrt("size"))
        .groupBy(F.col("_source").alias("_scaled"))
        .agg(F.min_by("scale", "size").alias("scale"))
    )


def uniform(column: str, seed: int) -> Column:
    """A number between 0 and 1 from the id, the same in every run and engine."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """How many copies of each document the mix takes.

    `doc_id, source, size, source_size, target, copies, taken`, a row per row of
    `docs`. Sources in order of code point, null last, weigh `weights` over and
    over; see `targets`. A source whose target is r times its words takes every
    document floor(r) times for certain. The rest is a Pareto order sample:
    documents are ranked by the odds of a random number over the odds of
    inclusion, and taken in that order until the words left are used up, so that
    the size is fixed. See `inclusion`; documents of probability 1 are certain and go
    first. Random numbers come from the id, so reruns agree; equal ranks go by id,
    then by size.

    A rank decides alone outside the range of ranks that holds the cut. Only that range,
    a small part of its source, is ordered; rows of the others are spread.

    The document on the border is taken if that brings the sum nearer to the target.
    Null and empty texts have size 0, and are never in the sampled part. Null ids and
    null sources are ordinary values; repeated rows are documents of their own with
    equal ranks. Empty tables give no rows.
    """
    rows = stored(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), uniform("doc_id", seed).alias("u")
        ),
        "mix-sizes",
    )
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    goals = (
        targets(sizes, weights, share, most)
        .withColumn("whole", F.coalesce(whole, F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "_source")
    )
    scales = inclusion(counts, goals)
    goals = stored(
        goals.join(scales, F.col("_source").eqNullSafe(F.col("_scaled")), "left").drop("_scaled"), "mix-goals"
    )
    chance = F.col("scale") / F.sqrt("size")
    odds = lambda p: p / (1.0 - p)
    rank = F.when(
        (F.col("rest") > 0) & (F.col("size") > 0),
        F.when(chance < 1, odds(F.col("u")) / odds(chance)).otherwise(F.lit(0.0)),
    )
    ranked = (
        rows.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rank", rank)
        .withColumn("range", F.floor(F.col("rank") / (1.0 + F.col("rank")) * RANGES).cast("int"))
    )
    so_far = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranked.where("range is not null")
        .groupBy("_source", "range")
        .agg(F.sum("size").alias("held"), F.max("rest").alias("rest"))
        .withColumn("before", F.coalesce(F.sum("held").over(so_far), F.lit(0)))
    )
    # The last range that starts within the words left holds the cut.
    cuts = (
        ranges.where("before <= rest")
        .groupBy(F.col("_source").alias("_of"))
        .agg(F.max("range").alias("cut"), F.max("before").alias("before"))
    )
    here = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    spread = -1 - F.pmod(F.xxhash64("doc_id", "size"), F.lit(RANGES))
    placed = ranked.join(cuts, F.col("_source").eqNullSafe(F.col("_of")), "left").withColumn(
        "group", F.when(here, F.lit(0)).otherwise(spread)
    )
    in_group = Window.partitionBy("_source", "group").orderBy("rank", "doc_id", "size")
    ends = F.col("before") + F.sum("size").over(in_group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("ends", ends)
    sampled = F.when(here, F.col("ends") - F.col("size") / 2 <= F.col("rest")).otherwise(
        F.col("range") < F.col("cut")
    )
    copies = F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("long")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with `copy` from 1 on.

    Rows with one id go in as often as the one taken most. Documents without words are
    left out, as no word of theirs is taken. All columns are kept, but a column called
    `copy` is replaced.
    """
    taken = (
        mix_sources(docs, **params)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("taken_id"))
        .agg(F.max("copies").cast("int").alias("times"))
    )
    kept = [(f"c{i}", name) for i, name in enumerate(docs.columns) if name != "copy"]
    rows = docs.select(*(F.col(f"`{name}`").alias(c) for c, name in kept))
    own = next(c for c, name in kept if name == "doc_id")
    return rows.join(taken, F.col(own).eqNullSafe(F.col("taken_id"))).select(
        *(F.col(c).alias(name) for c, name in kept),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
    )
