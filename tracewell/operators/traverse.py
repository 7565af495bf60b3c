"""Depth-limited breadth-first lineage for many seeds at once.

A graph is reduced once and stored in hash buckets of source and of target
(``snapshot``). The driver then loops over levels only: each level reads the
buckets that its frontier lies in, joins them with the frontier (broadcast where
it was counted and is small), drops what was visited, and is written out. Nodes
of all seeds travel together, so a batch of roots costs as many jobs as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import new_path, park

FORWARD, BACKWARD = "forward", "backward"
ROWS_PER_BUCKET, MOST_BUCKETS, FRONTIER_ROWS, ROWS_PER_SORT = 200_000, 4096, 20_000, 1_000_000
EDGE_KEYS, EDGE_REST = ["source_id", "target_id"], ["dependency_type", "reference_type"]
COLUMN_KEYS, COLUMN_REST = ["source_object_id", "source_column", "target_object_id", "target_column"], ["transformation", "transformation_type"]


@dataclass(frozen=True)
class Stored:
    """A table in hash buckets of a column."""

    rows: DataFrame
    key: str
    buckets: int
    path: str = ""

    def beside(self, frontier: DataFrame) -> DataFrame:
        """The rows whose key is an id of the frontier, with the frontier's columns; other buckets are not read."""
        rows, near = self.met(self.rows, frontier)
        return rows.drop("bucket").withColumnRenamed(self.key, "id").join(near, "id").withColumnRenamed("id", self.key)

    def met(self, rows: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of the frontier's buckets, and the frontier, broadcast if its count allows; else only the rows of its ids, found without sorting what is stored."""
        n, wanted = frontier.agg(F.count(F.lit(1)), F.collect_set(_bucket(F.col("id"), self.buckets))).first()  # at most one number a bucket
        rows = rows if len(wanted) == self.buckets else rows.where(F.col("bucket").isin(wanted))
        if n <= FRONTIER_ROWS:
            return rows, F.broadcast(frontier)
        ids = frontier.select(F.col("id").alias(self.key)).distinct()
        return rows.join(ids.hint("shuffle_hash"), self.key, "left_semi"), frontier


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store(df: DataFrame, key: str, buckets: int, name: str) -> Stored:
    """Write df by buckets of key; AQE splits a bucket that a hub makes large into several files."""
    return store_at(df, key, buckets, new_path(df.sparkSession, name))


def store_at(df: DataFrame, key: str, buckets: int, path: str) -> Stored:
    dealt = df.withColumn("bucket", _bucket(F.col(key), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return Stored(df.sparkSession.read.schema(dealt.schema).parquet(path), key, buckets, path)


def dealt_last(deps: DataFrame, pair: list[str], rest: list[str], buckets: int, rows: int = 0) -> DataFrame:
    """The last row of each pair (highest seq, ties to the larger attributes) with the bucket of the pair's first column, in one shuffle.

    Rows are dealt by ranges of bucket and pair, so a hub's lie in several parts. A part is sorted once, which settles its
    pairs and orders the files. The number of parts grows with the rows and is fixed, as parts that are put together again
    would not fit in memory.
    """
    order = [F.col("bucket"), *(F.col(c) for c in pair)]
    parts = max(int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_SORT)
    dealt = deps.withColumn("bucket", _bucket(F.col(pair[0]), buckets)).repartitionByRange(parts, *order)
    last = Window.partitionBy(*order).orderBy(*(F.col(c).desc() for c in ("seq", *rest)))
    return dealt.withColumn("place", F.row_number().over(last)).where("place = 1").select(*pair, *rest, "bucket")


def store_last(deps: DataFrame, pair: list[str], rest: list[str], buckets: int, path: str, rows: int = 0) -> Stored:
    """Write ``dealt_last`` by bucket; rows, if known, tells into how many parts to deal."""
    held = dealt_last(deps, pair, rest, buckets, rows)
    held.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return Stored(deps.sparkSession.read.schema(held.schema).parquet(path), pair[0], buckets, path)


def buckets_for(rows: int) -> int:
    return min(MOST_BUCKETS, max(1, rows // ROWS_PER_BUCKET))


@dataclass(frozen=True)
class Snapshot:
    """A graph ready to be walked: ids of objects, and one edge for each pair by source and by target."""

    ids: Stored
    by_source: Stored
    by_target: Stored

    def side(self, direction: str) -> Stored:
        return self.by_source if direction == FORWARD else self.by_target


def snapshot(objects: DataFrame, table_deps: DataFrame) -> Snapshot:
    """Reduce the edges (last wins) and store them both ways."""
    deps = park(table_deps.select(*EDGE_KEYS, *EDGE_REST, "seq"), "edges")
    rows = deps.count()
    n = buckets_for(rows)
    ids = objects.select("id").distinct().withColumn("known", F.lit(True))
    by_source = store_last(deps, EDGE_KEYS, EDGE_REST, n, new_path(deps.sparkSession, "edges-source"), rows)
    return Snapshot(store(ids, "id", n, "ids"), by_source, store(by_source.rows.drop("bucket"), "target_id", n, "edges-target"))


@dataclass
class Lineage:
    """nodes: seed, id, level, has_more_upstream, has_more_downstream. edges: seed and the edge's columns."""

    nodes: DataFrame
    edges: DataFrame


def last_wins(table_deps: DataFrame) -> DataFrame:
    """One edge for each (source_id, target_id): the one of the highest seq, ties to the larger attributes.

    Aggregates of structs and strings are made by sorting. Rows are dealt by pair first, so that only the parts of the
    shuffle are sorted, not what each task reads of the input, which may be many times as much. Their number is fixed, as
    parts that are put together again would not fit in memory.
    """
    rest = ["dependency_type", "reference_type"]
    return table_deps.repartition(int(table_deps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id", "target_id").groupBy("source_id", "target_id").agg(F.max_by(F.struct(*rest), F.struct("seq", *rest)).alias("e")).select("source_id", "target_id", "e.*")


def levels(graph: Snapshot, seeds: DataFrame, depth: int | None, direction: str = FORWARD, visited: DataFrame | None = None) -> DataFrame:
    """seed, id, level, known for everything reached within depth (None: without limit).

    seeds and visited: seed, id. Ids without an object are reached but not
    followed (known is false); visited ids have level -1 and are never entered.
    """
    far = "target_id" if direction == FORWARD else "source_id"

    def marked(reached: DataFrame, level: int) -> DataFrame:
        fresh = park(reached.select("seed", "id"), "bfs-reached")
        found = graph.ids.beside(fresh.select("id").distinct()).select("id", "known")
        return fresh.join(found, "id", "left").select("seed", "id", F.lit(level).alias("level"), F.coalesce("known", F.lit(False)).alias("known"))

    start = seeds.select("seed", "id").distinct()
    frontier = park(marked(start, 0), "bfs")
    seen = frontier
    if visited is not None:
        before = visited.select("seed", "id").distinct().join(start, ["seed", "id"], "left_anti")
        seen = seen.unionByName(before.select("seed", "id", F.lit(-1).alias("level"), F.lit(False).alias("known")))
    level = 0
    while depth is None or level < depth:
        reached = graph.side(direction).beside(frontier.where("known").select("seed", "id")).select("seed", F.col(far).alias("id")).distinct()
        level += 1
        frontier = park(marked(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), level), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _has_more(nodes: DataFrame, reached: DataFrame, side: Stored, far: str, name: str) -> DataFrame:
    """A neighbour is more if it wasn't reached or lies on a later level."""
    other = reached.select("seed", F.col("id").alias("neighbour"), F.col("level").alias("other_level"))
    beside = side.beside(nodes.select("seed", "id", "level")).select("seed", F.col(side.key).alias("id"), "level", F.col(far).alias("neighbour"))
    found = beside.join(other, ["seed", "neighbour"], "left")
    more = F.max(F.col("other_level").isNull() | (F.col("other_level") > F.col("level")))
    return found.groupBy("seed", "id").agg(more.alias(name))


def traverse(graph: Snapshot, seeds: DataFrame, depth: int | None, direction: str = FORWARD, visited: DataFrame | None = None) -> Lineage:
    """Nodes within depth of the seeds with their flags, and every edge out of the nodes that were expanded.

    Edges lead also to visited and to unknown ids; of several edges between two
    ids the last wins. An unknown seed gives no rows.
    """
    reached = levels(graph, seeds, depth, direction, visited)
    nodes = reached.where("known").select("seed", "id", "level")
    flags = {"has_more_upstream": (graph.by_target, "source_id"), "has_more_downstream": (graph.by_source, "target_id")}
    out = nodes
    for name, (side, far) in flags.items():
        out = out.join(_has_more(nodes, reached, side, far, name), ["seed", "id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    open_nodes = nodes if depth is None else nodes.where(F.col("level") < depth)
    followed = graph.side(direction).beside(open_nodes.select("seed", "id"))
    return Lineage(out.select("seed", "id", "level", *flags), followed.select("seed", "source_id", "target_id", "dependency_type", "reference_type"))


def full(graph: Snapshot, seeds: DataFrame, upstream_depth: int, downstream_depth: int) -> Lineage:
    """Both directions with their own visited sets; where both have a node, the downstream run's flags hold and the level is the smaller."""
    up = traverse(graph, seeds, upstream_depth, BACKWARD)
    down = traverse(graph, seeds, downstream_depth, FORWARD)
    both = up.nodes.withColumn("run", F.lit(0)).unionByName(down.nodes.withColumn("run", F.lit(1)))
    flags = ["has_more_upstream", "has_more_downstream"]
    nodes = both.groupBy("seed", "id").agg(F.min("level").alias("level"), *(F.max_by(c, "run").alias(c) for c in flags))
    edges = up.edges.unionByName(down.edges).dropDuplicates(["seed", "source_id", "target_id"])
    return Lineage(nodes, edges)


@dataclass(frozen=True)
class ColumnSnapshot:
    """Column edges ready to be walked, one for each pair of columns, by source and by target object."""

    by_source: Stored
    by_target: Stored


def column_snapshot(column_deps: DataFrame) -> ColumnSnapshot:
    """Reduce the column edges (last wins) and store them both ways."""
    deps = park(column_deps.select(*COLUMN_KEYS, *COLUMN_REST, "seq"), "column-edges")
    rows = deps.count()
    n = buckets_for(rows)
    by_source = store_last(deps, COLUMN_KEYS, COLUMN_REST, n, new_path(deps.sparkSession, "columns-source"), rows)
    return ColumnSnapshot(by_source, store(by_source.rows.drop("bucket"), "target_object_id", n, "columns-target"))


def resolve_columns(wanted: DataFrame, column_deps: DataFrame) -> DataFrame:
    """wanted (object_id, column) with found: the object's column of that exact name, else the smallest that differs in case only, else null."""
    ends = column_deps.select(F.col("source_object_id").alias("o"), F.col("source_column").alias("found")).unionByName(
        column_deps.select(F.col("target_object_id").alias("o"), F.col("target_column").alias("found"))
    )
    near = wanted.select("object_id", "column").distinct().join(ends, (F.col("object_id") == F.col("o")) & (F.upper("column") == F.upper("found")))
    best = near.groupBy("object_id", "column").agg(F.min_by("found", F.struct(F.col("found") != F.col("column"), "found")).alias("found"))
    return wanted.join(best, ["object_id", "column"], "left")


def column_steps(graph: ColumnSnapshot, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    """Column lineage as a tree: one row for each column discovered.

    seeds: seed, object_id, column. Of several parents on the level before, the
    smallest (object_id, column) is taken; among edges of one pair the last
    wins. The start itself is never in the result, and columns need no object.
    """
    rest = ["transformation", "transformation_type"]
    source, target = F.struct(F.col("source_object_id").alias("object_id"), F.col("source_column").alias("column")), F.struct(F.col("target_object_id").alias("object_id"), F.col("target_column").alias("column"))
    side, near, far = (graph.by_source, source, target) if direction == "downstream" else (graph.by_target, target, source)
    frontier = seeds.select("seed", F.struct("object_id", "column").alias("node")).distinct()
    seen, found = frontier, None
    choice = Window.partitionBy("seed", "node").orderBy("parent")
    for level in range(1, depth + 1):
        asked = frontier.select("seed", F.col("node").alias("parent"), F.col("node.object_id").alias("id"))
        step = side.beside(asked).where(near == F.col("parent")).select("seed", "parent", far.alias("node"), *rest)
        reached = step.join(seen, ["seed", "node"], "left_anti")
        best = reached.withColumn("place", F.row_number().over(choice)).where("place = 1")
        rows = park(best.select("seed", F.lit(level).alias("level"), "parent", "node", *rest), "columns")
        if rows.isEmpty():
            break
        frontier = rows.select("seed", "node")
        seen = seen.unionByName(frontier)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = _no_steps(seeds)
    return found.select(
        "seed", F.lit(direction).alias("direction"), "level", F.col("node.object_id").alias("object_id"), F.col("node.column").alias("column"),
        F.col("parent.object_id").alias("via_object_id"), F.col("parent.column").alias("via_column"), *rest,
    )


def _no_steps(seeds: DataFrame) -> DataFrame:
    key = F.struct("object_id", "column")
    none = F.lit(None).cast("string")
    return seeds.where(F.lit(False)).select("seed", F.lit(0).alias("level"), key.alias("parent"), key.alias("node"), none.alias("transformation"), none.alias("transformation_type"))


def column_lineage(graph: ColumnSnapshot, seeds: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """Upstream rows, then downstream rows, with visited sets of their own."""
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError("direction is upstream, downstream or both")
    parts = [column_steps(graph, seeds, depth, d) for d in ("upstream", "downstream") if direction in (d, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def object_columns(column_deps: DataFrame, object_id: str) -> DataFrame:
    """Depth 1 for all columns of an object in one pass: column, direction, neighbour; a column's edge to itself is left out."""
    at_target = column_deps.where(F.col("target_object_id") == object_id).select(
        F.col("target_column").alias("column"), F.lit("upstream").alias("direction"), F.col("source_object_id").alias("object_id"), F.col("source_column").alias("other_column"), "transformation", "transformation_type", "seq"
    )
    at_source = column_deps.where(F.col("source_object_id") == object_id).select(
        F.col("source_column").alias("column"), F.lit("downstream").alias("direction"), F.col("target_object_id").alias("object_id"), F.col("target_column").alias("other_column"), "transformation", "transformation_type", "seq"
    )
    rows = at_target.unionByName(at_source).where((F.col("object_id") != object_id) | (F.col("other_column") != F.col("column")))
    rest = F.struct("transformation", "transformation_type")
    best = rows.groupBy("column", "direction", "object_id", "other_column").agg(F.max_by(rest, F.struct("seq", "transformation", "transformation_type")).alias("e"))
    return best.select("column", "direction", "object_id", "other_column", "e.*")


def touching_columns(column_deps: DataFrame, object_id: str) -> DataFrame:
    """Every column edge at the object, duplicates kept."""
    return column_deps.where((F.col("source_object_id") == object_id) | (F.col("target_object_id") == object_id))


def columns_with_lineage(column_deps: DataFrame) -> DataFrame:
    """object_id and the sorted columns that any edge starts from or ends at."""
    ends = column_deps.select(F.col("source_object_id").alias("object_id"), F.col("source_column").alias("column")).unionByName(
        column_deps.select(F.col("target_object_id").alias("object_id"), F.col("target_column").alias("column"))
    )
    return ends.groupBy("object_id").agg(F.sort_array(F.collect_set("column")).alias("columns"))
