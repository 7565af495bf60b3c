"""Merging lineage graphs under four policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.catalog import first_wins

EDGE_KEY = ["source_id", "target_id"]
COLUMN_KEY = ["source_object_id", "source_column", "target_object_id", "target_column"]


def _filled(base: Column, new: Column, kind: T.DataType) -> Column:
    """base unless it is null or an empty string; an empty list stays."""
    empty = base.isNull() | (base == "") if isinstance(kind, T.StringType) else base.isNull()
    return F.when(empty, F.coalesce(new, base)).otherwise(base)


def last_of_each(objects: DataFrame, order: str = "object_id") -> DataFrame:
    """One row for each id: that of the highest order, as the last of a list holds; ties go by the hash of the row, so reruns agree."""
    place = F.struct(*([order] if order in objects.columns else []), F.xxhash64(*(F.to_json(F.struct(*objects.columns)),)).alias("hash"))
    rows = objects.groupBy("id").agg(F.max_by(F.struct(*objects.columns), place).alias("row"))
    return rows.select("row.*")


def enrich_objects(base: DataFrame, new: DataFrame, order: str = "object_id") -> DataFrame:
    """All objects of both; shared ones keep base's values and take new's where base has none.

    added and enriched tell where a row came from; source_platform is new's
    platform where base's is exasol and both are set. Of rows that share an id
    on one side the last by order holds.
    """
    base, new = last_of_each(base, order), last_of_each(new, order)
    types = {f.name: f.dataType for f in [*new.schema, *base.schema]}
    b = base.select(F.col("id").alias("bid"), F.struct(*base.columns).alias("b"))
    n = new.select(F.col("id").alias("nid"), F.struct(*new.columns).alias("n"))
    both = b.join(n, F.col("bid") == F.col("nid"), "full_outer")

    def value(c: str) -> Column:
        if c not in base.columns:
            return F.col("n")[c]
        if c not in new.columns:
            return F.col("b")[c]
        return _filled(F.col("b")[c], F.col("n")[c], types[c])

    out = [value(c).alias(c) for c in dict.fromkeys([*base.columns, *new.columns])]
    if "platform" in base.columns and "platform" in new.columns:
        taken = (F.col("b.platform") == "exasol") & (F.coalesce(F.col("n.platform"), F.lit("")) != "")
        out.append(F.when(taken, F.col("n.platform")).alias("source_platform"))
    return both.select(*out, F.col("bid").isNull().alias("added"), (F.col("bid").isNotNull() & F.col("nid").isNotNull()).alias("enriched"))


def append_new(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base as it is, duplicates included, and the first row (by seq) of each key of new that base lacks; null keys are dropped from new."""
    complete = new
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    fresh = first_wins(complete, keys, "seq").join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def _counted(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    return before.agg((-F.count(F.lit(1))).alias("n")).unionAll(after.agg(F.count(F.lit(1)))).agg(F.sum("n").alias(name))


def merge_counters(objects: DataFrame, base_deps: DataFrame, merged_deps: DataFrame, base_columns: DataFrame | None = None, merged_columns: DataFrame | None = None) -> DataFrame:
    """objects from enrich_objects: added and enriched objects, added edges and, where given, added column edges."""
    a = objects.agg(F.count_if("added").alias("added_objects"), F.count_if("enriched").alias("enriched_objects"))
    out = a.join(_counted(base_deps, merged_deps, "added_dependencies"))  # one row each
    return out if base_columns is None else out.join(_counted(base_columns, merged_columns, "added_column_dependencies"))


def prefixed(c: Column, prefix: str = "exasol:") -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def merge_platforms(objects: DataFrame, deps: DataFrame, other_objects: DataFrame, other_deps: DataFrame, prefix: str = "exasol:") -> tuple[DataFrame, DataFrame]:
    """The first platform's ids and edge ends get the prefix; edges are appended without dedup; of one id the other platform's object holds."""
    own = objects.withColumn("id", prefixed(F.col("id"), prefix)).join(other_objects.select("id"), "id", "left_anti").select(*objects.columns)
    ends = {c: prefixed(F.col(c), prefix) for c in EDGE_KEY}
    return own.unionByName(other_objects), deps.withColumns(ends).unionByName(other_deps)


def merge_first(objects: DataFrame, deps: DataFrame, new_objects: DataFrame, new_deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing objects and edges win; nothing is enriched."""
    fresh = first_wins(new_objects, ["id"], "object_id").join(objects.select("id"), "id", "left_anti")
    return objects.unionByName(fresh.select(*objects.columns)), append_new(deps, new_deps, EDGE_KEY)
