"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b, distinct). Neighbours of each node move to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label (smallest node of its component) for every node of edges (a, b) that isn't the smallest itself.

    The steps are repeated until nothing changes; each is written out, so no
    lineage grows and lost executors cost one step at most.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = park(ordered, "cc"), None
    for _ in range(max_rounds):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now
        state = park(_star(_star(state, large=True), large=False), "cc")
    raise RuntimeError("components did not settle")
