"""A layered sample graph of any width, from spark.range and seeded hashes: the same rows for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schemas import COLUMN_DEP, OBJECT, TABLE_DEP, conform
from tracewell.sources.cache import CacheTables

# layer: schema, type, share of the width, edges from the layer before, their type
LAYERS = [
    ("CONNECTION", "CONNECTION", 0.03, 0, None, None), ("VS", "VIRTUAL_SCHEMA", 0.02, 1, "CONNECTION", "USES"), ("RAW", "TABLE", 0.25, 1, "ETL", "SELECT"),
    ("STG", "TABLE", 0.2, 3, "ETL", "INSERT_SELECT"), ("DWH", "TABLE", 0.1, 5, "ETL", "INSERT_SELECT"), ("MART", "VIEW", 0.2, 4, "VIEW", "SELECT"),
    ("REPORT", "VIEW", 0.1, 3, "VIEW", "SELECT"), ("UDF", "LUA_UDF", 0.1, 1, "UDF_INPUT", "PARAMETER"),
]
CHAIN_LEVELS = 12
CLASSES = ["DIRECT", "DIRECT", "DIRECT", "EXPRESSION", "AGGREGATE", "CASE", "CAST", "FUNCTION"]


def _pick(n: int, seed: int, *salt: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *salt), F.lit(max(1, n)))


def sample_graph(spark: SparkSession, width: int = 450, seed: int = 42, columns: int = 5, chains: int = 5) -> CacheTables:
    """About width objects in eight layers; every object but the first layer's has edges from the layer before, every edge two column edges.

    Beside them stand chains of CHAIN_LEVELS tables, each fed by the one before.
    """
    objects = deps = None
    before = None
    for schema, kind, share, fan_in, dep, ref in LAYERS:
        n = max(1, int(width * share))
        ids = spark.range(n)
        id_ = F.format_string(f"{schema}.{schema}_%06d", "id")
        cols = F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: F.struct(F.concat(F.lit("C_"), i.cast("string")).alias("name"), F.lit("VARCHAR(255)").alias("data_type"), i.cast("int").alias("ordinal_position"), F.lit(True).alias("is_nullable"), F.lit(False).alias("is_primary_key"), F.lit(None).cast("string").alias("description")))
        rows = ids.select(id_.alias("id"), F.lit(schema).alias("schema"), F.format_string(f"{schema}_%06d", "id").alias("name"), F.lit(kind).alias("type"), F.lit("SYS").alias("owner"),
            (F.col("id") + 100_000 * (1 + [x[0] for x in LAYERS].index(schema))).alias("object_id"), F.lit("exasol").alias("platform"), _pick(10_000_000, seed, id_).alias("row_count"), cols.alias("columns"))
        rows = conform(rows, OBJECT)
        objects = rows if objects is None else objects.unionByName(rows)
        if before:
            above, m = before
            source = F.format_string(f"{above}.{above}_%06d", _pick(m, seed, F.col("id"), F.col("k"), F.lit(schema)))
            edges = ids.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(fan_in)))).select(source.alias("source_id"), id_.alias("target_id"), F.lit(dep).alias("dependency_type"), F.lit(ref).alias("reference_type"), F.xxhash64("id", "k").alias("seq"))
            edges = conform(edges, TABLE_DEP)
            deps = edges if deps is None else deps.unionByName(edges)
        before = (schema, n)
    links = spark.range(chains * CHAIN_LEVELS).select((F.col("id") / CHAIN_LEVELS).cast("int").alias("chain"), (F.col("id") % CHAIN_LEVELS).cast("int").alias("level"))
    link = lambda level: F.format_string("CHAIN.CHAIN_%02d_%02d", "chain", level)
    rows = links.select(link(F.col("level")).alias("id"), F.lit("CHAIN").alias("schema"), F.format_string("CHAIN_%02d_%02d", "chain", "level").alias("name"), F.lit("TABLE").alias("type"), F.lit("SYS").alias("owner"),
        (F.lit(2_000_000) + F.col("chain") * CHAIN_LEVELS + F.col("level")).alias("object_id"), F.lit("exasol").alias("platform"))
    objects = objects.unionByName(conform(rows, OBJECT))
    steps = links.where("level > 0").select(link(F.col("level") - 1).alias("source_id"), link(F.col("level")).alias("target_id"), F.lit("ETL").alias("dependency_type"), F.lit("INSERT_SELECT").alias("reference_type"), F.col("level").alias("seq"))
    deps = deps.unionByName(conform(steps, TABLE_DEP))
    k = F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k")
    pairs = deps.select("source_id", "target_id").distinct().select("source_id", "target_id", k)
    col = lambda salt: F.concat(F.lit("C_"), (_pick(columns, seed, F.col("source_id"), F.col("target_id"), F.col("k"), F.lit(salt)) + 1).cast("string"))
    kind = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), (_pick(len(CLASSES), seed, F.col("source_id"), F.col("target_id"), F.col("k")) + 1).cast("int"))
    cols = pairs.select(F.col("source_id").alias("source_object_id"), col("s").alias("source_column"), F.col("target_id").alias("target_object_id"), col("t").alias("target_column"), kind.alias("transformation_type"), F.col("k").cast("long").alias("seq"))
    return CacheTables(objects, deps, conform(cols, COLUMN_DEP))
