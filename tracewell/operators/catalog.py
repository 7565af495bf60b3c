"""Search, filters, pages, distinct lists, statistics and inverted indexes over the objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(query: str) -> Column:
    """The query, case ignored and taken literally, occurs in name, schema or id."""
    q = query.lower()
    return F.lower("name").contains(q) | F.lower("schema").contains(q) | F.lower("id").contains(q)


def filtered(objects: DataFrame, schema: str | None = None, type_: str | None = None) -> DataFrame:
    if schema is not None:
        objects = objects.where(F.col("schema") == schema)
    if type_ is not None:
        objects = objects.where(F.col("type") == type_)
    return objects


def search(objects: DataFrame, query: str, limit: int = 50, schema: str | None = None, type_: str | None = None) -> DataFrame:
    """The first matches by id."""
    return filtered(objects, schema, type_).where(matches(query)).orderBy("id").limit(limit)


def page(objects: DataFrame, number: int = 1, size: int = 50, schema: str | None = None, type_: str | None = None) -> DataFrame:
    return filtered(objects, schema, type_).orderBy("id").offset((number - 1) * size).limit(size)


def total_pages(total: int, size: int) -> int:
    return -(-total // size)


def included(column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Include-then-exclude list filter; an empty include list takes all."""
    ok = F.col(column).isin(include) if include else F.lit(True)
    return ok & ~F.col(column).isin(exclude) if exclude else ok


def distinct_sorted(objects: DataFrame, column: str) -> DataFrame:
    return objects.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def statistics(objects: DataFrame, table_deps: DataFrame, column_deps: DataFrame) -> DataFrame:
    """One row of counts; edges are counted with their duplicates."""
    counted = {"total_tables": "TABLE", "total_views": "VIEW", "total_udfs": "LUA_UDF", "total_virtual_schemas": "VIRTUAL_SCHEMA", "total_connections": "CONNECTION"}
    a = objects.agg(
        F.countDistinct("id").alias("total_objects"), F.countDistinct("schema").alias("total_schemas"), *(F.count_if(F.col("type") == t).alias(name) for name, t in counted.items())
    )
    b = table_deps.agg(F.count(F.lit(1)).alias("total_dependencies"))
    ends = F.explode(F.array("source_object_id", "target_object_id")).alias("o")
    c = column_deps.select(ends, F.lit(0.5).alias("half")).agg(F.sum("half").cast("long").alias("n"), F.countDistinct("o").alias("m"))
    c = c.select(F.coalesce("n", F.lit(0)).alias("total_column_dependencies"), F.col("m").alias("objects_with_column_lineage"))
    return a.join(b).join(c)  # one row each


def inverted_index(objects: DataFrame, column: str) -> DataFrame:
    """Distinct (value, id) rows, the index of a schema, type or any other column; a value's ids are rows, as they can be many."""
    return objects.select(column, "id").distinct()


def adjacency(table_deps: DataFrame, direction: str = "forward", duplicates: bool = False) -> DataFrame:
    """Neighbour lists, as sets unless duplicates are asked for."""
    near, far = ("source_id", "target_id") if direction == "forward" else ("target_id", "source_id")
    collect = F.collect_list if duplicates else F.collect_set
    return table_deps.groupBy(F.col(near).alias("id")).agg(F.sort_array(collect(far)).alias("neighbours"))


def cache_counters(objects: DataFrame, table_deps: DataFrame) -> DataFrame:
    a = objects.agg(F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum(F.greatest(F.size("columns"), F.lit(0))), F.lit(0)).cast("long").alias("column_count"))
    return a.join(table_deps.agg(F.count(F.lit(1)).alias("dependency_count")))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest order for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
