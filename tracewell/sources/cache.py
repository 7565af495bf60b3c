"""Cache documents: one JSON text with objects and dependencies in any of the known layouts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.catalog import cache_counters, inverted_index
from tracewell.sources.jsonscan import scan
from tracewell.schemas import COLUMN_DEP, OBJECT, TABLE_DEP, conform, validate, with_defaults
from tracewell.storage import join_files, park


@dataclass
class CacheTables:
    objects: DataFrame
    table_deps: DataFrame
    column_deps: DataFrame


def _ddl(schema: T.StructType) -> str:
    return schema.simpleString()


_LOOSE_DEP = T.StructType([T.StructField(c, T.StringType()) for c in ("source_object_id", "source_id", "source", "target_object_id", "target_id", "target", "dependency_type", "reference_type")])


CONTAINERS = ["objects", "dependencies", "dependencies.table_level", "dependencies.column_level"]


def read_cache(spark: SparkSession, path: str) -> CacheTables:
    """Objects as map or list; dependencies as {table_level, column_level}, a list, or a map.

    The document is one file of any size, on one line or many, and read by many
    tasks (``jsonscan``). Raises FileNotFoundError where nothing is found and
    ValueError where a part is missing or the objects break the model. Unknown
    keys, and entries that are no objects, are left out.
    """
    from pyspark.errors import AnalysisException

    try:
        found = scan(spark, path, CONTAINERS)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    top = found.where((F.col("kind") == "key") & F.col("key").isin("metadata", "objects", "dependencies"))
    present = {r.key for r in top.select("key").distinct().collect()}
    for key in ("metadata", "objects", "dependencies"):
        if key not in present:
            raise ValueError(f"the cache has no {key}")
    structured = not found.where((F.col("kind") == "container") & F.col("path").isin(*CONTAINERS[2:])).isEmpty()

    def elements(path: str) -> DataFrame:
        return found.where((F.col("kind") == "element") & (F.col("path") == path)).select(F.col("place").alias("seq"), "key", "text")

    named = elements("objects").select("key", F.from_json("text", _ddl(OBJECT)).alias("o")).select("o.*", "key").withColumn("id", F.coalesce("id", "key", F.col("object_id").cast("string")))
    objects = validate(park(conform(named, OBJECT), "cache-objects"))
    loose = elements(CONTAINERS[2] if structured else "dependencies").select("seq", F.from_json("text", _ddl(_LOOSE_DEP)).alias("d"))
    deps = loose.select(
        F.coalesce("d.source_object_id", "d.source_id", "d.source").alias("source_id"), F.coalesce("d.target_object_id", "d.target_id", "d.target").alias("target_id"),
        "d.dependency_type", "d.reference_type", "seq",
    )
    deps = with_defaults(conform(deps, TABLE_DEP).where("source_id IS NOT NULL AND target_id IS NOT NULL"))
    cols = elements(CONTAINERS[3]).select("seq", F.from_json("text", _ddl(COLUMN_DEP)).alias("c")).select("c.*", F.col("seq").alias("n")).drop("seq")
    cols = conform(cols.withColumnRenamed("n", "seq"), COLUMN_DEP).where("source_object_id IS NOT NULL AND target_object_id IS NOT NULL")
    return CacheTables(objects, park(deps, "cache-edges"), park(with_defaults(column_deps=cols), "cache-columns"))


def write_tables(tables: CacheTables, path: str) -> None:
    """The graph as Parquet below path, by any number of tasks: three tables, their counters, and four indexes as rows.

    schema_index and type_index hold (value, id), forward and backward (id, neighbour).
    """
    for name in ("objects", "table_deps", "column_deps"):
        getattr(tables, name).write.mode("overwrite").parquet(f"{path}/{name}")
    pairs = tables.table_deps.select("source_id", "target_id").distinct()
    more = {
        "metadata": cache_counters(tables.objects, tables.table_deps), "schema_index": inverted_index(tables.objects, "schema"), "type_index": inverted_index(tables.objects, "type"),
        "forward": pairs.toDF("id", "neighbour"), "backward": pairs.select("target_id", "source_id").toDF("id", "neighbour"),
    }
    for name, rows in more.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> CacheTables:
    return CacheTables(*(spark.read.parquet(f"{path}/{name}") for name in ("objects", "table_deps", "column_deps")))


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def cache_document(tables: CacheTables, source: str = "tracewell") -> DataFrame:
    """One JSON text in the cache layout. It holds the whole graph in one row: for exchange of small graphs only."""
    objects = tables.objects.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*tables.objects.columns))), _by_id)).alias("objects"), F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum(F.greatest(F.size("columns"), F.lit(0))), F.lit(0)).alias("column_count"))
    deps = tables.table_deps.agg(F.sort_array(F.collect_list(F.struct("seq", "source_id", "target_id", "dependency_type", "reference_type"))).alias("table_level"))
    cols = tables.column_deps.agg(F.sort_array(F.collect_list(F.struct("seq", *(c for c in tables.column_deps.columns if c != "seq")))).alias("column_level"))
    meta = F.struct(F.lit(source).alias("source"), "object_count", "column_count", F.size("table_level").alias("dependency_count"))
    return objects.join(deps).join(cols).select(F.to_json(F.struct(meta.alias("metadata"), "objects", F.struct("table_level", "column_level").alias("dependencies"))).alias("value"))


# The parts of a document in their order: the text before the first entry, and after the last.
_FRAME = [
    ("objects", '"objects": {', "},"), ("table_level", '"dependencies": {"table_level": [', "],"), ("column_level", '"column_level": [', "]},"),
    ("by_schema", '"indexes": {"by_schema": {', "},"), ("by_type", '"by_type": {', "},"), ("forward", '"forward": {', "},"), ("backward", '"backward": {', "}}"),
]
_ORDER = ["section", "a", "place", "b"]


def _json_text(c: str) -> Column:
    listed = F.to_json(F.array(c))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _comma(first: Column, text: Column) -> Column:
    return F.when(first, text).otherwise(F.concat(F.lit(", "), text))


def _entries(rows: DataFrame) -> DataFrame:
    """rows (a, text) in the order of a, with commas between: a, place, b, text. Rows alike in both are put into one line."""
    alike = rows.groupBy("a", "text").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("b", F.md5("text"))
    least = alike.agg(F.min(F.struct("a", "b")).alias("least"))  # one row
    text = F.array_join(F.array_repeat("text", F.col("n")), ", ")
    return alike.join(least).select("a", F.lit(0).alias("place"), "b", _comma(F.struct("a", "b") == F.col("least"), text).alias("text"))


def _lists(rows: DataFrame) -> DataFrame:
    """rows (a, b) as lists of b under the key a, each b a line of its own: a, place, b, text."""
    rows = rows.distinct()
    keys = rows.groupBy("a").agg(F.min("b").alias("b0"))
    least = keys.agg(F.min("a").alias("a0"))  # one row
    begin = keys.join(least).select("a", F.lit(0).alias("place"), F.lit("").alias("b"), _comma(F.col("a") == F.col("a0"), F.concat(_json_text("a"), F.lit(": ["))).alias("text"))
    body = rows.join(keys, "a").select("a", F.lit(1).alias("place"), "b", _comma(F.col("b") == F.col("b0"), _json_text("b")).alias("text"))
    return begin.unionByName(body).unionByName(keys.select("a", F.lit(2).alias("place"), F.lit("").alias("b"), F.lit("]").alias("text")))


def document_lines(tables: CacheTables, source: str = "tracewell") -> DataFrame:
    """section, a, place, b, text: a cache document in lines, to be read in the order of the first four.

    Metadata with counters; objects by id, edges by seq; and four indexes: ids by schema and by type, neighbours either way.
    An id in an index is a line, so no row grows with the graph. A null schema or type stands under the empty string.
    """
    objects, edges, columns = tables.objects, tables.table_deps, tables.column_deps
    pairs = edges.select("source_id", "target_id").distinct()
    seq = F.lpad(F.coalesce("seq", F.lit(0)).cast("string"), 20, "0").alias("a")
    counted = cache_counters(objects, edges).select(F.to_json(F.struct(F.lit(source).alias("source"), "object_count", "column_count", "dependency_count")).alias("m"))
    head = counted.select(F.lit(0).alias("section"), F.lit("").alias("a"), F.lit(0).alias("place"), F.lit("").alias("b"), F.concat(F.lit('{"metadata": '), "m", F.lit(",")).alias("text"))
    parts = {
        "objects": _entries(objects.select(F.col("id").alias("a"), F.concat(_json_text("id"), F.lit(": "), F.to_json(F.struct(*objects.columns))).alias("text"))),
        "table_level": _entries(edges.select(seq, F.to_json(F.struct("source_id", "target_id", "dependency_type", "reference_type")).alias("text"))),
        "column_level": _entries(columns.select(seq, F.to_json(F.struct(*(c for c in columns.columns if c != "seq"))).alias("text"))),
        "by_schema": _lists(objects.select(F.coalesce("schema", F.lit("")).alias("a"), F.col("id").alias("b"))),
        "by_type": _lists(objects.select(F.coalesce("type", F.lit("")).alias("a"), F.col("id").alias("b"))),
        "forward": _lists(pairs.toDF("a", "b")), "backward": _lists(pairs.select("target_id", "source_id").toDF("a", "b")),
    }
    frame = [(3 * k + j, text) for k, (_, begin, end) in enumerate(_FRAME) for j, text in ((1, begin), (3, end))] + [(3 * len(_FRAME) + 1, "}")]
    out = head.unionByName(head.sparkSession.createDataFrame([(k, "", 0, "", t) for k, t in frame], head.schema))
    for k, (name, _, _) in enumerate(_FRAME):
        out = out.unionByName(parts[name].select(F.lit(3 * k + 2).alias("section"), "a", "place", "b", "text"))
    return out


def write_document(tables: CacheTables, path: str, source: str = "tracewell") -> None:
    """One JSON file in the cache layout, written by any number of tasks: each sorts and writes a range of its lines, then the files are joined."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    document_lines(tables, source).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("text").write.text(parts)
    join_files(tables.objects.sparkSession, parts, path)


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """index, key, id: the rows of the four indexes of a document."""
    found = scan(spark, path, [f"indexes.{n}" for n, *_ in _FRAME[3:]]).where("kind = 'element'")
    return found.select(F.regexp_replace("path", "^indexes\\.", "").alias("index"), "key", F.explode(F.from_json("text", "array<string>")).alias("id"))


def numbered(rows: DataFrame, order: list[str], start: int = 100_000) -> DataFrame:
    """object_id counted up from start in the given order, range by range: no sort of everything in one task.

    Rows are range-partitioned by the order; partition totals give each range its first number.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order)
    placed = park(ranged.withColumn("n", F.row_number().over(inside)), "numbered")  # both branches below see the same parts
    sizes = placed.groupBy("part").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("part", "before")), "part").withColumn("object_id", F.col("n") - 1 + F.col("before") + start).drop("part", "n", "before")
