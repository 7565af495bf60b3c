"""The visible part of a graph: expanding, collapsing, highlighting, exporting.

A view has nodes (id, level, has_more_upstream, has_more_downstream) and edges
(source_id, target_id, attributes), both for one root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.closure import closure
from tracewell.operators.traverse import BACKWARD, FORWARD, Snapshot, full, snapshot, traverse

PAIR = ["source_id", "target_id"]


@dataclass
class View:
    root: str
    nodes: DataFrame
    edges: DataFrame


def _seed(rows: DataFrame, id_: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(id_, id_)], "seed string, id string")


def load(graph: Snapshot, root: str) -> View:
    """The root with one step both ways; also what collapsing everything returns to."""
    found = full(graph, _seed(graph.ids.rows, root), 1, 1)
    return View(root, found.nodes.drop("seed"), found.edges.drop("seed"))


def expand(view: View, graph: Snapshot, id_: str, direction: str = FORWARD) -> View:
    """Add one step from a node. Known nodes take the new flags; only new nodes and edges are added.

    A new node's level is a step beyond that of the node it was reached from.
    """
    found = traverse(graph, _seed(graph.ids.rows, id_), 1, direction)
    flags = ["has_more_upstream", "has_more_downstream"]
    own = view.nodes.where(F.col("id") == id_).agg(F.min("level")).first()[0] or 0
    fresh = found.nodes.select("id", (F.col("level") + own).alias("new_level"), *(F.col(c).alias(f"new_{c}") for c in flags))
    nodes = view.nodes.join(fresh, "id", "full_outer").select("id", F.coalesce("level", "new_level").alias("level"), *(F.coalesce(f"new_{c}", c).alias(c) for c in flags))
    edges = view.edges.unionByName(found.edges.drop("seed").join(view.edges.select(*PAIR), PAIR, "left_anti"))
    return View(view.root, nodes, edges)


def collapse(view: View, id_: str, direction: str = FORWARD) -> View:
    """Drop what the visible edges reach from a node in one direction, never the root; edges that lose an end go too."""
    shown = snapshot(view.nodes, view.edges if "seq" in view.edges.columns else view.edges.withColumn("seq", F.lit(0).cast("long")))
    reached = closure(shown, _seed(view.nodes, id_), direction)
    gone = reached.where((F.col("id") != id_) & (F.col("id") != view.root)).select("id").distinct()
    nodes = view.nodes.join(gone, "id", "left_anti")
    near = "source_id" if direction == FORWARD else "target_id"
    edges = view.edges.where(F.col(near) != id_)
    for c in PAIR:
        edges = edges.join(gone.withColumnRenamed("id", c), c, "left_anti")
    return View(view.root, nodes, edges.select(*view.edges.columns))


def highlight(edges: DataFrame, id_: str) -> DataFrame:
    """Edges with is_highlighted: one step from the node either way."""
    return edges.withColumn("is_highlighted", (F.col("source_id") == id_) | (F.col("target_id") == id_))


def affordances(nodes: DataFrame, expanded_up: DataFrame, expanded_down: DataFrame, root: str) -> DataFrame:
    """Which of expand and collapse each node offers, either way."""
    out = nodes
    for name, flag, ids in (("up", "has_more_upstream", expanded_up), ("down", "has_more_downstream", expanded_down)):
        out = out.join(ids.select("id", F.lit(True).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        out = out.withColumn(f"can_expand_{name}", F.col(flag) & ~F.col("open")).withColumn(f"can_collapse_{name}", F.col("open") & (F.col("id") != root)).drop("open")
    return out


def panel_columns(objects: DataFrame, lineage_columns: DataFrame) -> DataFrame:
    """id, columns: those with lineage (less empty and UNKNOWN), else those of the catalog."""
    useful = lineage_columns.select(F.col("object_id").alias("id"), F.filter("columns", lambda c: (c != "") & (c != "UNKNOWN")).alias("traced"))
    own = F.coalesce(F.col("columns.name"), F.array().cast("array<string>"))
    return objects.join(useful, "id", "left").select("id", F.when(F.coalesce(F.size("traced"), F.lit(0)) > 0, F.col("traced")).otherwise(own).alias("columns"))


def edge_export(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Seven columns for the CSV of visible edges; edges with an unknown end are left out."""
    ends = {}
    for side in ("source", "target"):
        ends[side] = objects.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("schema", "name", "type")))
    joined = edges.join(ends["source"], "source_id").join(ends["target"], "target_id")
    titles = {"source_schema": "Source Schema", "source_name": "Source Name", "source_type": "Source Type", "target_schema": "Target Schema", "target_name": "Target Name", "target_type": "Target Type"}
    return joined.select(*(F.col(c).alias(t) for c, t in titles.items()), F.coalesce("dependency_type", F.lit("DEPENDENCY")).alias("Dependency Type"))


__all__ = ["BACKWARD", "FORWARD", "View", "affordances", "collapse", "edge_export", "expand", "highlight", "load", "panel_columns"]
