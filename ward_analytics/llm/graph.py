"""Connected components of a graph given as edges, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm.tables import cut


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that can be reached; nodes without edges don't occur. edges: a, b (long).

    Alternates two rounds: every node's larger neighbours, then its smaller ones, are linked to the smallest it
    sees, until the edges are stars. The number of rounds grows with the logarithm of the largest component, no node's
    neighbours ever meet in one task, and each round is a checkpoint.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sum(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        sums = _sum(now)
        if sums == seen:
            break
        seen = sums
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
