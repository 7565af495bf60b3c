"""Everything that seeds reach, without a limit of depth, in few rounds.

The first ``WALKED`` levels are walked on the stored graph, which reads each edge
a level at most. Most graphs end there; the merging below, which costs joins of
all nodes, is for those that go on.

A node with one predecessor is reached exactly if that one is, so it is merged
into it. All such nodes are merged at once: each points to its predecessor, and
pointers are doubled until they lead to nodes that can't be merged, which takes
rounds in the logarithm of the longest run, however long chains and rings are.
Merging gives other nodes a single predecessor, so it is repeated while it pays.
What is left is walked level by level, and every class reached brings its
members along.

A round writes its table and cuts the lineage. Seeds are never merged, so any
number of seeds shares the merged graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.traverse import FORWARD, Snapshot, levels
from tracewell.storage import park

WALKED = 5
PAYS = 0.05  # merging goes on while it takes this share of the edges


def closure(graph: Snapshot, seeds: DataFrame, direction: str = FORWARD) -> DataFrame:
    """seed, id for everything reached from seeds (seed, id), these included; ids without an object are reached but not followed."""
    near, far = ("source_id", "target_id") if direction == FORWARD else ("target_id", "source_id")
    start = park(seeds.select("seed", "id").distinct(), "closure-seeds")
    near_by = levels(graph, start, WALKED, direction)
    if near_by.where((F.col("level") == WALKED) & F.col("known")).isEmpty():
        return near_by.select("seed", "id")
    known = graph.ids.rows.select(F.col("id").alias("a"))
    edges = graph.side(direction).rows.select(F.col(near).alias("a"), F.col(far).alias("b")).where(F.col("a") != F.col("b")).join(known, "a", "left_semi")
    edges, members = _merged(park(edges, "closure-edges"), start.select("id").distinct())
    reached = _walk(edges, start)
    return reached if members is None else reached.unionByName(members.join(reached.withColumnRenamed("id", "rep"), "rep").select("seed", F.col("node").alias("id")))


def _merged(edges: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """edges (a, b) between classes, and node, rep of the nodes that went into another class. Ids in fixed stay."""
    members = None
    while True:
        single = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where(F.col("n") == 1).select("b", "a")
        single = park(single.join(fixed.withColumnRenamed("id", "b"), "b", "left_anti"), "closure-single")
        found, total = single.count(), edges.count()
        if not found:
            return edges, members
        roots = _roots(single, found)
        lost = roots.where("open").select(F.col("b").alias("id"))
        roots = roots.where(~F.col("open")).select("b", F.col("a").alias("root"))
        inner = edges.join(single.select("b"), "b", "left_anti")  # the only edge into a merged node goes
        moved = inner.join(roots.withColumnRenamed("b", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        moved = moved.join(lost.withColumnRenamed("id", "a"), "a", "left_anti").where(F.col("a") != F.col("b")).distinct()
        fresh = roots.select(F.col("b").alias("node"), F.col("root").alias("rep"))
        if members is not None:
            old = members.join(roots.withColumnRenamed("b", "rep"), "rep", "left").select("node", F.coalesce("root", "rep").alias("rep"))
            fresh = old.unionByName(fresh)
        edges, members = park(moved, "closure-edges"), park(fresh, "closure-members")
        if found < PAYS * total:
            return edges, members


def _roots(pointers: DataFrame, n: int) -> DataFrame:
    """pointers (b, a) followed to their ends: b, a, open. Open are those that lead into a ring of pointers, which no seed reaches."""
    ends = pointers.select(F.col("b").alias("a"), F.lit(True).alias("open"))
    state = pointers.join(ends, "a", "left").select("b", "a", F.coalesce("open", F.lit(False)).alias("open"))
    for _ in range(max(1, (n.bit_length() + 1) // 2)):
        state = park(_doubled(_doubled(state)), "closure-pointers")
        if state.where("open").isEmpty():
            break
    return state


def _doubled(state: DataFrame) -> DataFrame:
    ahead = state.select(F.col("b").alias("a"), F.col("a").alias("far"), F.col("open").alias("far_open"))
    moved = state.where("open").join(ahead, "a").select("b", F.col("far").alias("a"), F.col("far_open").alias("open"))
    return state.where(~F.col("open")).unionByName(moved)


def _walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    frontier = seen = start.select("seed", "id")
    while True:
        step = frontier.join(edges, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        frontier = park(step.join(seen, ["seed", "id"], "left_anti"), "closure-reached")
        if frontier.isEmpty():
            return seen
        seen = park(seen.unionByName(frontier), "closure-seen")
