"""Lineage across platforms from a table of synchronisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import blank, dotted, first_filled, warehouse_id
from tracewell.operators.catalog import first_wins

SYNC_COLUMNS = [
    "batch_name", "task_name", "table_type", "bq_project_id", "bq_dataset_id", "bq_table_name", "exa_stg_schema_name", "exa_stg_table_name",
    "exa_dm_schema_name", "exa_dm_table_name", "is_snapshot",
]


def sync_rows(records: DataFrame) -> DataFrame:
    """Distinct rows with a table name, and the ids each of them stands for. A row's number orders it."""
    rows = records.select(*SYNC_COLUMNS).distinct().where(blank(F.col("bq_table_name")).isNotNull())
    rows = rows.withColumn("source", warehouse_id(F.col("bq_project_id"), F.col("bq_dataset_id"), F.col("bq_table_name")))
    for kind in ("stg", "dm"):
        table = blank(F.col(f"exa_{kind}_table_name"))
        rows = rows.withColumn(kind, F.when(table.isNotNull(), F.upper(dotted(F.col(f"exa_{kind}_schema_name"), table))))
    batch = blank(F.col("batch_name"))
    job = F.when(batch.isNotNull(), F.upper(F.concat(F.lit("SYNC."), batch, F.lit("."), F.coalesce("task_name", F.lit("None"))))).otherwise(F.concat(F.lit("SYNC."), F.col("source")))
    rows = rows.withColumn("job", F.when(F.col("stg").isNotNull(), job))
    rows = rows.withColumn("job_name", first_filled(F.col("task_name"), F.col("batch_name"), F.concat(F.lit("SYNC_"), F.col("bq_table_name"))))
    return rows.withColumn("row_order", F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SYNC_COLUMNS)))


def bridge_objects(records: DataFrame) -> DataFrame:
    """id, schema, name, type, platform of source, staging, job and mart objects; the first row of an id holds."""
    rows = sync_rows(records)

    def part(id_: str, schema, name, type_: str, platform: str) -> DataFrame:
        cols = rows.where(F.col(id_).isNotNull())
        return cols.select(F.col(id_).alias("id"), schema.alias("schema"), name.alias("name"), F.lit(type_).alias("type"), F.lit(platform).alias("platform"), "row_order")

    parts = [
        part("source", F.upper(dotted(F.col("bq_project_id"), F.col("bq_dataset_id"))), F.upper("bq_table_name"), "BIGQUERY_TABLE", "bigquery"),
        part("stg", F.upper("exa_stg_schema_name"), F.upper("exa_stg_table_name"), "TABLE", "exasol"),
        part("job", F.lit("SYNC"), F.col("job_name"), "SYNC_JOB", "bridge"),
        part("dm", F.upper("exa_dm_schema_name"), F.upper("exa_dm_table_name"), "TABLE", "exasol"),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return first_wins(union, ["id"], "row_order")


def bridge_edges(records: DataFrame) -> DataFrame:
    """source → job → staging → mart, or source → mart without staging; not deduplicated."""
    staged, marted = F.col("stg").isNotNull(), F.col("dm").isNotNull()

    def edge(condition, source: str, target: str, kind: str, reference: str):
        return F.when(condition, F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("dependency_type"), F.lit(reference).alias("reference_type")))

    edges = F.array(
        edge(staged, "source", "job", "SYNC", "BQ_TO_SYNC"), edge(staged, "job", "stg", "SYNC", "SYNC_TO_EXASOL"),
        edge(staged & marted, "stg", "dm", "ETL", "STG_TO_DM"), edge(~staged & marted, "source", "dm", "SYNC", "BQ_TO_EXASOL"),
    )
    return sync_rows(records).select(F.explode(F.array_compact(edges)).alias("e")).select("e.*")


def bridge_columns(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """Column edges from mappings (bq_full_name, bq_col, exa_col) to the staging table, or the mart without one."""
    rows = sync_rows(records).withColumn("target", F.coalesce("stg", "dm")).where(F.col("target").isNotNull())
    full = F.upper(dotted(F.col("bq_project_id"), F.col("bq_dataset_id"), F.col("bq_table_name")))
    joined = rows.withColumn("full", full).join(mappings.withColumn("full", F.upper("bq_full_name")), "full")
    return joined.select(
        F.col("source").alias("source_object_id"), F.col("bq_col").alias("source_column"), F.col("target").alias("target_object_id"), F.col("exa_col").alias("target_column"),
        F.lit(None).cast("string").alias("transformation"), F.lit("DIRECT").alias("transformation_type"),
    )
