"""From catalog objects and script text to dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewell.functions.ids import blank, dotted, first_filled, name_of, reference_id, schema_of, string_list
from tracewell.functions.sqltext import column_lineage, create_target, named_refs, script_refs, table_refs
from tracewell.schemas import WRITE_TYPES


def resolve(refs: DataFrame, objects: DataFrame, ref_schema: str = "ref_schema", ref_name: str = "ref_name") -> DataFrame:
    """refs with object_id: the object of that exact schema and name, else the smallest id with that name, else null."""
    wanted = refs.withColumn("wanted", F.upper(dotted(F.col(ref_schema), F.col(ref_name))))
    exact = objects.select(F.upper("id").alias("wanted"), F.col("id").alias("exact_id")).groupBy("wanted").agg(F.min("exact_id").alias("exact_id"))
    by_name = objects.groupBy(F.upper(name_of(F.col("id"))).alias("n")).agg(F.min("id").alias("name_id"))
    found = wanted.join(exact, "wanted", "left").join(by_name, F.upper(F.col(ref_name)) == F.col("n"), "left")
    return found.withColumn("object_id", F.coalesce("exact_id", "name_id")).select(*refs.columns, "object_id")


def placeholders(ids: DataFrame, objects: DataFrame, id_col: str = "id", type_: str = "BIGQUERY_TABLE") -> DataFrame:
    """Objects for ids that the catalog lacks."""
    missing = ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().join(objects.select("id"), "id", "left_anti")
    plain = F.regexp_replace("id", "^[a-z]+:", "")
    return missing.select("id", schema_of(plain).alias("schema"), name_of(plain).alias("name"), F.lit(type_).alias("type"), F.lit("External reference").alias("description"))


def catalog_dependencies(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of the system's dependency view whose both ends exist, typed by the kind of the dependent object."""
    from tracewell.functions.ids import dependency_type

    edges = rows.select(
        dotted(F.col("REFERENCED_OBJECT_SCHEMA"), F.col("REFERENCED_OBJECT_NAME")).alias("source_id"), dotted(F.col("OBJECT_SCHEMA"), F.col("OBJECT_NAME")).alias("target_id"),
        dependency_type(F.col("OBJECT_TYPE")).alias("dependency_type"), first_filled(F.col("REFERENCE_TYPE"), F.lit("SELECT")).alias("reference_type"),
    )
    ids = objects.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def view_dependencies(views: DataFrame, objects: DataFrame, existing: DataFrame | None = None, **names) -> DataFrame:
    """views: id, definition. Resolved references into the view, without itself and without pairs that exist."""
    refs = table_refs(views, ["id"], "definition", **names)
    found = resolve(refs, objects).where(F.col("object_id").isNotNull() & (F.col("object_id") != F.col("id")))
    edges = found.select(F.col("object_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("VIEW").alias("dependency_type"), "reference_type")
    edges = edges.groupBy("source_id", "target_id", "dependency_type").agg(F.min("reference_type").alias("reference_type")).select("source_id", "target_id", "dependency_type", "reference_type")
    return edges if existing is None else edges.join(existing.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def known_refs(scripts: DataFrame, objects: DataFrame, **names) -> DataFrame:
    """script_refs with object_id, less those that no object answers to; what a script creates or drops stays, with a null object_id if unknown."""
    refs = script_refs(scripts, ["id"], "script_text", "script_language", **names)
    return resolve(refs, objects).where(F.col("object_id").isNotNull() | (F.col("reference_type") == "DDL"))


def script_dependencies(scripts: DataFrame, objects: DataFrame, **names) -> DataFrame:
    """scripts: id, script_text, script_language. Written tables come after the script, read ones before it."""
    found = known_refs(scripts, objects, **names).where(F.col("object_id").isNotNull() & (F.col("object_id") != F.col("id")))
    writes = F.col("reference_type").isin(WRITE_TYPES)
    return found.select(
        F.when(writes, F.col("id")).otherwise(F.col("object_id")).alias("source_id"), F.when(writes, F.col("object_id")).otherwise(F.col("id")).alias("target_id"),
        F.when(writes, "UDF_OUTPUT").otherwise("UDF_INPUT").alias("dependency_type"), "reference_type",
    )


def warehouse_dependencies(objects: DataFrame, project: str, dataset: str, **names) -> tuple[DataFrame, DataFrame]:
    """objects: id, type, definition of the second platform. Edges (reads USES, a routine's writes WRITES) and placeholders for unknown references.

    References are looked up without regard to case before they become placeholders.
    What a reference leaves out comes from the object's own id, else from project and dataset.
    """
    own = lambda k: F.coalesce(blank(F.regexp_extract("id", r"^bigquery:([^.]+)\.([^.]+)\..+$", k)), F.lit((project, dataset)[k - 1]))
    text = objects.where(F.col("definition").isNotNull())
    refs = named_refs(text, ["id", "type"], "definition", require_schema=True, **names)
    wanted = reference_id(F.concat_ws(".", "ref_catalog", "ref_schema", "ref_name"), own(1), own(2))
    known = objects.groupBy(F.lower("id").alias("low")).agg(F.min("id").alias("known_id"))
    found = refs.withColumn("wanted", wanted).join(known, F.lower("wanted") == F.col("low"), "left").withColumn("other", F.coalesce("known_id", "wanted"))
    found = found.where(F.col("other") != F.col("id"))
    writes = F.col("type").isin("BIGQUERY_PROCEDURE", "BIGQUERY_UDF") & F.col("reference_type").isin(WRITE_TYPES)
    edges = found.select(
        F.when(writes, F.col("id")).otherwise(F.col("other")).alias("source_id"), F.when(writes, F.col("other")).otherwise(F.col("id")).alias("target_id"),
        F.when(writes, "WRITES").otherwise("USES").alias("dependency_type"), "reference_type",
    )
    return edges, placeholders(found, objects, "other")


def dag_dependencies(dags: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dags: dag_id, source_tables and target_tables as arrays or JSON texts of arrays. Read and write edges, and placeholders for unknown tables."""
    texts = [c for c in ("source_tables", "target_tables") if not isinstance(dags.schema[c].dataType, ArrayType)]
    dags = dags.withColumns({c: string_list(F.col(c)) for c in texts})
    dag = F.concat(F.lit("composer:"), F.col("dag_id"))
    reads = dags.select(F.explode("source_tables").alias("t"), dag.alias("d")).select(
        F.concat(F.lit("bigquery:"), "t").alias("source_id"), F.col("d").alias("target_id"), F.lit("READS").alias("dependency_type"), F.lit("DAG_INPUT").alias("reference_type")
    )
    writes = dags.select(F.explode("target_tables").alias("t"), dag.alias("d")).select(
        F.col("d").alias("source_id"), F.concat(F.lit("bigquery:"), "t").alias("target_id"), F.lit("WRITES").alias("dependency_type"), F.lit("DAG_OUTPUT").alias("reference_type")
    )
    ids = reads.select(F.col("source_id").alias("id")).unionByName(writes.select(F.col("target_id").alias("id")))
    return reads.unionByName(writes), placeholders(ids, objects)


def corpus_graph(files: DataFrame, compat: bool = False, text_chars: int | None = None, **names) -> tuple[DataFrame, DataFrame]:
    """files: path, content. One object per CREATE target, a DATA edge from each referenced table; the target's own name only with compat.

    sql_text is the whole file, or its first text_chars characters.
    """
    text = F.col("content") if text_chars is None else F.substring("content", 1, text_chars)
    made = files.withColumn("t", create_target(F.col("content"))).where(F.col("t").isNotNull())
    target = made.select("path", "content", F.upper(F.concat(F.lit("BIGQUERY."), F.col("t.full_name"))).alias("id"), F.col("t.name").alias("name"), F.col("t.object_type").alias("type"))
    objects = target.groupBy("id").agg(F.min_by(F.struct("name", "type", F.col("path").alias("source_file"), text.alias("sql_text")), "path").alias("o")).select("id", "o.*")
    refs = named_refs(target, ["path", "id"], "content", **names)
    edges = refs.select(F.concat(F.lit("BIGQUERY."), dotted(F.col("ref_catalog"), F.col("ref_schema"), F.col("ref_name"))).alias("source_id"), F.col("id").alias("target_id"), F.lit("DATA").alias("dependency_type"), "reference_type").distinct()
    return objects, edges if compat else edges.where(F.col("source_id") != F.col("target_id"))


def view_column_dependencies(views: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Column edges of all views (id, definition); with objects, source names are mapped to ids without regard to case."""
    found = column_lineage(views, "id", "definition").withColumnRenamed("id", "target_object_id")
    if objects is not None:
        known = objects.groupBy(F.upper("id").alias("up")).agg(F.min("id").alias("known_id"))
        found = found.join(known, F.col("source_object_id") == F.col("up"), "left").withColumn("source_object_id", F.coalesce("known_id", "source_object_id"))
    return found.select("source_object_id", "source_column", "target_object_id", "target_column", "transformation", "transformation_type")


def columns_by_name(deps: DataFrame, objects: DataFrame) -> DataFrame:
    """For view edges: source columns that a view column equals or whose name the view's text holds, class UNKNOWN."""
    names = F.transform("columns.name", lambda c: F.struct(c.alias("name"), F.upper(c).alias("up")))
    s = objects.select(F.col("id").alias("source_id"), names.alias("sources"))
    views = objects.where(F.col("type") == "VIEW")
    v = views.select(F.col("id").alias("target_id"), F.upper("definition").alias("text"), names.alias("targets"))
    # One row for each edge: which source columns the text holds is looked up once, and the text goes before columns are paired.
    pairs = deps.select("source_id", "target_id").join(s, "source_id").join(v, "target_id")
    inside = F.transform("sources", lambda c: F.struct(c["name"].alias("name"), c["up"].alias("up"), F.coalesce(F.contains("text", c["up"]), F.lit(False)).alias("held")))
    each = pairs.select("source_id", "target_id", "targets", F.explode(inside).alias("s"))
    hits = F.filter("targets", lambda t: F.col("s.held") | (t["up"] == F.col("s.up")))
    found = each.select("source_id", "target_id", F.col("s.name").alias("source_column"), F.explode(F.transform(hits, lambda t: t["name"])).alias("target_column"))
    return found.select(
        F.col("source_id").alias("source_object_id"), "source_column", F.col("target_id").alias("target_object_id"), "target_column",
        F.lit(None).cast("string").alias("transformation"), F.lit("UNKNOWN").alias("transformation_type"),
    )


def corpus_counters(files: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a run over repositories: repos and SQL files seen, objects and edges found. files: repo, path, content."""
    seen = files.agg(F.countDistinct("repo").alias("repos_scanned"), F.countDistinct("path").alias("sql_files_parsed"))
    found = objects.agg(F.count(F.lit(1)).alias("objects_found"))
    return seen.join(found).join(edges.agg(F.count(F.lit(1)).alias("dependencies_found")))  # one row each
