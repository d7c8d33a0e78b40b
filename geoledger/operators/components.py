"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected(links: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node each linked node can reach; ``links`` has columns a and b.

    Large-star and small-star steps: every node's neighbours are hung under
    the smallest one, first the larger neighbours, then the others. Each step
    is an aggregation and a join, both over links, and a written table; the
    number of rounds grows with the logarithm of the longest chain.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both if larger else both.where("b < a")
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        hung = both.join(low, "a")
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if larger else (
            hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        )
        return written(moved.where("a <> b").distinct(), label)

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    before = state(edges)
    while before[0]:
        edges = star(star(edges, True), False)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
