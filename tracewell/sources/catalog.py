"""Snapshots of remote catalogs as objects. A snapshot is any DataFrame with the catalog's columns: spark.read.jdbc, Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import dotted, first_filled, hash_id, platform_id, type_list
from tracewell.operators.catalog import included
from tracewell.schemas import OBJECT, conform


def _object(rows: DataFrame, **columns: Column) -> DataFrame:
    return conform(rows.select(*(c.alias(name) for name, c in columns.items())), OBJECT)


def _text(value: str) -> Column:
    return F.lit(value)


def connections(rows: DataFrame) -> DataFrame:
    c = F.col("CONNECTION_NAME")
    return _object(rows, id=F.concat(_text("CONNECTION."), c), schema=_text("CONNECTION"), name=c, type=_text("CONNECTION"), owner=first_filled(F.col("USER_NAME"), _text("SYS")),
        object_id=hash_id(c), platform=_text("exasol"), connection_string=F.col("CONNECTION_STRING"), user=F.col("USER_NAME"), created_at=F.col("CREATED"), description=F.col("CONNECTION_COMMENT"))


def virtual_schemas(rows: DataFrame) -> DataFrame:
    s = F.col("SCHEMA_NAME")
    return _object(rows, id=F.concat(s, _text(".VIRTUAL_SCHEMA")), schema=s, name=s, type=_text("VIRTUAL_SCHEMA"), owner=first_filled(F.col("SCHEMA_OWNER"), _text("SYS")),
        object_id=F.col("SCHEMA_OBJECT_ID"), platform=_text("exasol"), adapter_name=F.col("ADAPTER_SCRIPT"), description=F.col("ADAPTER_NOTES"))


def column_lists(rows: DataFrame) -> DataFrame:
    """One ordered column array for each (COLUMN_SCHEMA, COLUMN_TABLE)."""
    column = F.struct(
        F.col("COLUMN_ORDINAL_POSITION").cast("int").alias("ordinal_position"), F.col("COLUMN_NAME").alias("name"), F.col("COLUMN_TYPE").alias("data_type"),
        F.col("COLUMN_IS_NULLABLE").cast("boolean").alias("is_nullable"), F.lit(False).alias("is_primary_key"), F.col("COLUMN_COMMENT").alias("description"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(column)), lambda c: F.struct(c["name"], c["data_type"], c["ordinal_position"], c["is_nullable"], c["is_primary_key"], c["description"]))
    return rows.groupBy(F.col("COLUMN_SCHEMA").alias("cs"), F.col("COLUMN_TABLE").alias("ct")).agg(ordered.alias("columns"))


def tables(rows: DataFrame, columns: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    joined = rows.where(included("TABLE_SCHEMA", include, exclude)).join(column_lists(columns), (F.col("TABLE_SCHEMA") == F.col("cs")) & (F.col("TABLE_NAME") == F.col("ct")), "left")
    return _object(joined, id=dotted(F.col("TABLE_SCHEMA"), F.col("TABLE_NAME")), schema=F.col("TABLE_SCHEMA"), name=F.col("TABLE_NAME"), type=_text("TABLE"), owner=first_filled(F.col("TABLE_OWNER"), _text("SYS")),
        object_id=F.col("TABLE_OBJECT_ID"), platform=_text("exasol"), description=F.col("TABLE_COMMENT"), row_count=F.col("TABLE_ROW_COUNT"), columns=F.coalesce("columns", F.array()))


def views(rows: DataFrame, columns: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    joined = rows.where(included("VIEW_SCHEMA", include, exclude)).join(column_lists(columns), (F.col("VIEW_SCHEMA") == F.col("cs")) & (F.col("VIEW_NAME") == F.col("ct")), "left")
    return _object(joined, id=dotted(F.col("VIEW_SCHEMA"), F.col("VIEW_NAME")), schema=F.col("VIEW_SCHEMA"), name=F.col("VIEW_NAME"), type=_text("VIEW"), owner=first_filled(F.col("VIEW_OWNER"), _text("SYS")),
        object_id=F.col("VIEW_OBJECT_ID"), platform=_text("exasol"), description=F.col("VIEW_COMMENT"), definition=F.col("VIEW_TEXT"), columns=F.coalesce("columns", F.array()))


def scripts(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    kept = rows.where(F.col("SCRIPT_LANGUAGE").isin("LUA", "PYTHON") & included("SCRIPT_SCHEMA", include, exclude))
    return _object(kept, id=dotted(F.col("SCRIPT_SCHEMA"), F.col("SCRIPT_NAME")), schema=F.col("SCRIPT_SCHEMA"), name=F.col("SCRIPT_NAME"), type=_text("LUA_UDF"), owner=first_filled(F.col("SCRIPT_OWNER"), _text("SYS")),
        object_id=F.col("SCRIPT_OBJECT_ID"), platform=_text("exasol"), description=F.col("SCRIPT_COMMENT"), udf_type=F.col("SCRIPT_TYPE"), script_language=F.col("SCRIPT_LANGUAGE"), script_text=F.col("SCRIPT_TEXT"),
        input_parameters=type_list(F.col("SCRIPT_INPUT_TYPE"), "param"), output_columns=type_list(F.col("SCRIPT_RESULT_TYPE"), "col"))


def metadata_scripts(rows: DataFrame, id_column: str, name_column: str, script_columns: list[str], schema_column: str | None = None, where: str | None = None, language: str = "SQL", default_schema: str = "METADATA") -> DataFrame:
    """Scripts kept in a table of one's own: the filled script columns joined by line breaks."""
    kept = rows.where(where) if where else rows
    text = F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in script_columns))
    schema = F.coalesce(F.nullif(F.col(schema_column), F.lit("")), F.lit(default_schema)) if schema_column else F.lit(default_schema)
    lua = language.upper() == "LUA"
    out = _object(kept, id=dotted(schema, F.col(name_column)), schema=schema, name=F.col(name_column), type=_text("LUA_UDF" if lua else "VIEW"), owner=_text("SYS"), object_id=hash_id(F.col(id_column).cast("string")),
        platform=_text("exasol"), definition=F.lit(None) if lua else text, script_text=text if lua else F.lit(None), script_language=F.lit(language.upper()))
    return out.where(F.coalesce("definition", "script_text") != "")


def warehouse_columns(rows: DataFrame) -> DataFrame:
    """One ordered column array for each (project_id, dataset_id, table_name)."""
    column = F.struct(F.col("ordinal_position").cast("int").alias("ordinal_position"), F.col("column_name").alias("name"), F.col("data_type"), (F.col("is_nullable") == "YES").alias("is_nullable"))
    ordered = F.transform(F.sort_array(F.collect_list(column)), lambda c: F.struct(c["name"], c["data_type"], c["ordinal_position"], c["is_nullable"], F.lit(False).alias("is_primary_key"), F.lit(None).cast("string").alias("description")))
    return rows.groupBy("project_id", "dataset_id", "table_name").agg(ordered.alias("columns"))


def _warehouse(rows: DataFrame, columns: DataFrame | None, name: str, type_: Column, **more: Column) -> DataFrame:
    if columns is not None:
        rows = rows.join(warehouse_columns(columns).withColumnRenamed("table_name", name), ["project_id", "dataset_id", name], "left")
    id_ = platform_id("bigquery", F.col("project_id"), F.col("dataset_id"), F.col(name))
    cols = {"columns": F.coalesce("columns", F.array())} if columns is not None else {}
    return _object(rows, id=id_, schema=dotted(F.col("project_id"), F.col("dataset_id")), name=F.col(name), type=type_, owner=F.col("project_id"), object_id=hash_id(id_), platform=_text("bigquery"), **cols, **more)


def warehouse_tables(rows: DataFrame, columns: DataFrame) -> DataFrame:
    return _warehouse(rows.where(F.col("table_type") == "BASE TABLE"), columns, "table_name", _text("BIGQUERY_TABLE"), created_at=F.col("creation_time"))


def warehouse_views(rows: DataFrame, columns: DataFrame) -> DataFrame:
    return _warehouse(rows, columns, "table_name", _text("BIGQUERY_VIEW"), definition=F.col("view_definition"))


def warehouse_routines(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("routine_type") == "FUNCTION", "BIGQUERY_UDF").otherwise("BIGQUERY_PROCEDURE")
    return _warehouse(rows, None, "routine_name", kind, definition=F.col("routine_definition"), created_at=F.col("created"), modified_at=F.col("last_altered"))


def dags(rows: DataFrame) -> DataFrame:
    id_ = F.concat(_text("composer:"), F.col("dag_id"))
    return _object(rows, id=id_, schema=_text("composer"), name=first_filled(F.col("dag_name"), F.col("dag_id")), type=_text("COMPOSER_DAG"), owner=_text("composer"), object_id=hash_id(id_),
        platform=_text("composer"), description=F.col("description"))


def in_datasets(rows: DataFrame, datasets: dict[str, list[str] | None]) -> DataFrame:
    """Rows (project_id, dataset_id) of the given projects: of a project's listed datasets, or of all where the list is None."""
    wanted = F.lit(False)
    for project, names in datasets.items():
        here = F.col("project_id") == project
        wanted = wanted | (here if names is None else here & F.col("dataset_id").isin(names))
    return rows.where(wanted)
