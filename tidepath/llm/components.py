"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """`node, component` for every node of `links` (`a`, `b`, both long); the component is
    the smallest node that can be reached.

    Each round, every node points at the neighbour of lowest rank, if that is
    lower than its own; ranks are hashes, so that chains of any order shrink to
    about half. Links are carried over to what their ends point at, and those
    within one node fall away, until none is left. Then the pointers are followed
    back through the rounds. Each round is stored, so its lineage is short, and a
    node with very many links is summed before the shuffle.

    Nulls link nothing, links from a node to itself and repeats have no effect.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                    F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
                )
            )
        )
        # The rank orders nodes; two numbers sum before the shuffle where a struct does not.
        lowest = (
            both.withColumn("rank", F.xxhash64("other"))
            .groupBy("node")
            .agg(F.min("rank").alias("rank"), F.min_by("other", "rank").alias("other"))
        )
        pointers = stored(
            lowest.where(F.col("rank") < F.xxhash64("node")).select("node", F.col("other").alias("to")),
            "pointers",
        )
        rounds.append(pointers)
        to_a = pointers.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = stored(
            edges.join(to_a, "a", "left")
            .join(to_b, "b", "left")
            .select(F.coalesce("to_a", "a").alias("p"), F.coalesce("to_b", "b").alias("q"))
            .where("p <> q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct(),
            "links",
        )
    found = nodes.withColumn("at", F.col("node"))
    for pointers in rounds:
        step = pointers.select(F.col("node").alias("at"), "to")
        found = found.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    smallest = found.groupBy("at").agg(F.min("node").alias("component"))
    return stored(found.join(smallest, "at").select("node", "component"), "components")
