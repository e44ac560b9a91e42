"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable), for every node of an edge
    (columns a, b of type long).

    Alternating large-star and small-star steps: each hooks the neighbours of a
    node to the smallest of them, so the paths shrink to stars in about the
    logarithm of the largest component's size. Minima are pre-aggregated before
    the shuffle and joined back, so no node's neighbours meet in one place. Each
    step is written to the shared folder. An edge of a node to itself adds the
    node alone."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b <= a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        hooked = both.join(least, "a")
        if large:
            hooked = hooked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            hooked = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return hooked.filter("a != b").distinct()

    def size(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())

    nodes = edges.select(F.col("a").alias("node")).unionByName(
        edges.select(F.col("b").alias("node"))).distinct()
    now = stage(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = size(now)
    while seen[0]:
        now = stage(star(star(now, large=True), large=False), name)
        if (after := size(now)) == seen:
            break
        seen = after
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component"))
