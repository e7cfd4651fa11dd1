"""Connected components of links, by alternating large and small stars.

Every round hooks nodes to their smallest neighbour: the large star moves a node's
greater neighbours to its smallest one, the small star its smaller ones. The
links become stars around each component's smallest node. Sums go by partial
aggregation, and a node with very many links is one row on the small side of a
join, which Spark splits when it is skewed. Each round is written to the shared
folder; rounds end when links stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """`node, component` of every node with a link; links: `a < b`."""
    def saved(links: DataFrame, k: int) -> tuple[DataFrame, dict]:
        """The links as a table, and their number and sum of hashes, taken as they are written."""
        state = Observation()
        table = scratch.save(links.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), f"{name}-{k}")
        return table, state.get

    (now, state), before, k = saved(links.select("a", "b").distinct(), 0), None, 0
    while state != before:
        before, k = state, k + 1
        now, state = saved(_small_star(_large_star(now)), k)
        scratch.drop(f"{name}-{k - 1}")
    heads = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(heads)
