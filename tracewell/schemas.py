"""The lineage data model: objects, table edges, column edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the model.
OBJECT_TYPES = [
    "TABLE", "VIEW", "LUA_UDF", "VIRTUAL_SCHEMA", "CONNECTION", "BIGQUERY_TABLE", "BIGQUERY_VIEW", "BIGQUERY_UDF",
    "BIGQUERY_PROCEDURE", "PROCEDURE", "FUNCTION", "COMPOSER_DAG", "SYNC_JOB",
]
PLATFORMS = ["exasol", "bigquery", "composer", "bridge"]
TRANSFORMATION_TYPES = ["DIRECT", "AGGREGATE", "EXPRESSION", "CASE", "CAST", "FUNCTION", "UNKNOWN"]
WRITE_TYPES = ["INSERT", "UPDATE", "DELETE", "MERGE", "DDL"]
REQUIRED = ["id", "schema", "name", "type", "owner", "object_id"]

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
COLUMN = T.StructType([
    T.StructField("name", _S), T.StructField("data_type", _S), T.StructField("ordinal_position", T.IntegerType()),
    T.StructField("is_nullable", _B), T.StructField("is_primary_key", _B), T.StructField("description", _S),
])
_PAIRS = T.ArrayType(T.MapType(_S, _S))
OBJECT = T.StructType(
    [T.StructField(c, _S) for c in ("id", "schema", "name", "type", "owner")]
    + [T.StructField("object_id", _L)]
    + [T.StructField(c, _S) for c in ("platform", "description", "definition", "udf_type", "script_language", "script_text", "adapter_name", "connection_name", "remote_schema", "connection_string", "user")]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("created_at", "modified_at")]
    + [T.StructField(c, _L) for c in ("row_count", "size_bytes")]
    + [T.StructField(c, _PAIRS) for c in ("input_parameters", "output_columns")]
    + [T.StructField("properties", T.MapType(_S, _S)), T.StructField("columns", T.ArrayType(COLUMN))]
)
TABLE_DEP = T.StructType([T.StructField(c, _S) for c in ("source_id", "target_id", "dependency_type", "reference_type")] + [T.StructField("seq", _L)])
COLUMN_DEP = T.StructType(
    [T.StructField(c, _S) for c in ("source_object_id", "source_column", "target_object_id", "target_column", "transformation", "transformation_type")]
    + [T.StructField("seq", _L)]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, in its order and types; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def with_defaults(table_deps: DataFrame | None = None, column_deps: DataFrame | None = None) -> DataFrame:
    """Table edges default to DATA and SELECT, column edges to DIRECT."""
    if table_deps is not None:
        return table_deps.withColumns({"dependency_type": F.coalesce("dependency_type", F.lit("DATA")), "reference_type": F.coalesce("reference_type", F.lit("SELECT"))})
    return column_deps.withColumn("transformation_type", F.coalesce("transformation_type", F.lit("DIRECT")))


def broken_objects(objects: DataFrame) -> DataFrame:
    """Rows that the model doesn't admit: a mandatory field is null, or type or platform is outside its domain."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    wrong = ~F.col("type").isin(OBJECT_TYPES) | (F.col("platform").isNotNull() & ~F.col("platform").isin(PLATFORMS))
    return objects.withColumn("missing", missing).where((F.size("missing") > 0) | wrong)


def validate(objects: DataFrame) -> DataFrame:
    """objects, or ValueError naming the first broken row or that there is none."""
    if objects.isEmpty():
        raise ValueError("the graph has no objects")
    bad = broken_objects(objects).select("id", "type", "platform", "missing").first()
    if bad:
        raise ValueError(f"object {bad.id!r}: missing {bad.missing}, type {bad.type!r}, platform {bad.platform!r}")
    return objects
