"""Connected components of a link table, by alternating star contraction (a distributed union-find).

Every round replaces links by links to the smallest neighbour: first from larger nodes, then from smaller ones. Links shrink to stars
in a number of rounds that grows with the logarithm of the longest path. Each round is written to the shared folder, so a lost executor
costs one round. A hub with very many links is never one task: its smallest neighbour comes from a pre-aggregated minimum, and the join
that follows can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b. Large star: every node links its larger neighbours to its minimum; small star: its smaller ones."""
    if large:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b): component is the smallest node that can be reached. Nulls and loops are ignored."""
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    state = None
    while True:
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == state or not seen.n:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        state = tuple(seen)
        links = written(_star(_star(links, True), False), "links")
