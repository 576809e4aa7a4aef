"""Connected components of a graph whose edges don't fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges (a long, b long).

    Alternates large-star and small-star steps: both keep connectivity, never add edges, and end in stars around each
    smallest node after a number of rounds that grows with the logarithm of the component's size. Every step is a
    partial aggregate and a join, each round is cut from its lineage. Null ends and loops count for nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, mark = _settle(now)
    for _ in range(MAX_ROUNDS):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), 2 * mark[0])
        large = few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b"), mark[0])
        large = few(large.distinct(), mark[0])
        least = few(large.groupBy("a").agg(F.min("b").alias("m")), mark[0])
        small = few(large.join(least, "a"), mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after, at = _settle(few(small.where("a > b").distinct(), mark[0]))
        if at == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(few(after.select(F.col("b"), F.col("b")).distinct(), mark[0]))
        now, mark = after, at
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = cut(edges, together=True)
    at = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(at)
