"""A lineage graph from the star-schema tables, the input of the registered queries.

Regions feed nations, nations feed customers and suppliers, customers feed
orders, orders and suppliers feed parts. Parts above size 45 have no object, so
their ids dangle. Line items give order-part edges with duplicates, of which
the highest line number holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import traverse
from tracewell.operators.versions import GraphStore
from tracewell.storage import exists, fingerprint, shared_dir

_OBJECTS = """
SELECT concat('R.', r_regionkey) AS id, 'GEO' AS schema, r_name AS name, 'CONNECTION' AS type, CAST(NULL AS BIGINT) AS row_count FROM region
UNION ALL SELECT concat('N.', n_nationkey), 'GEO', n_name, 'VIRTUAL_SCHEMA', NULL FROM nation
UNION ALL SELECT concat('S.', s_suppkey), 'SUP', s_name, 'TABLE', CAST(floor(s_acctbal * 1000) + 1 AS BIGINT) FROM supplier
UNION ALL SELECT concat('C.', c_custkey), c_mktsegment, c_name, 'TABLE', CAST(floor(c_acctbal * 1000) + 1 AS BIGINT) FROM customer
UNION ALL SELECT concat('O.', o_orderkey), 'ORD', concat('ORDER_', o_orderkey), 'VIEW', CAST(floor(o_totalprice * 10000) + 1 AS BIGINT) FROM orders
UNION ALL SELECT concat('P.', p_partkey), 'CAT', p_name, 'LUA_UDF', CAST(p_size AS BIGINT) FROM part WHERE p_size <= 45
"""
_EDGES = """
SELECT concat('R.', n_regionkey) AS source_id, concat('N.', n_nationkey) AS target_id, 'CONNECTION' AS dependency_type, 'USES' AS reference_type, CAST(0 AS BIGINT) AS seq FROM nation
UNION ALL SELECT concat('N.', c_nationkey), concat('C.', c_custkey), 'ETL', 'INSERT_SELECT', 0 FROM customer
UNION ALL SELECT concat('N.', s_nationkey), concat('S.', s_suppkey), 'ETL', 'INSERT_SELECT', 0 FROM supplier
UNION ALL SELECT concat('C.', o_custkey), concat('O.', o_orderkey), 'VIEW', 'SELECT', 0 FROM orders
UNION ALL SELECT concat('O.', l_orderkey), concat('P.', l_partkey), CASE l_returnflag WHEN 'A' THEN 'UDF_INPUT' WHEN 'R' THEN 'UDF_OUTPUT' ELSE 'DATA' END, 'PARAMETER', CAST(l_linenumber AS BIGINT) FROM lineitem
UNION ALL SELECT DISTINCT concat('S.', l_suppkey), concat('P.', l_partkey), 'ETL', 'SELECT', CAST(0 AS BIGINT) FROM lineitem
"""
_COLUMN_EDGES = """
SELECT concat('C.', o_custkey) AS source_object_id, CASE o_orderkey % 2 WHEN 0 THEN 'BALANCE' ELSE 'NAME' END AS source_column, concat('O.', o_orderkey) AS target_object_id, 'TOTAL' AS target_column,
       CASE WHEN o_orderkey % 3 = 0 THEN 'SUM(BALANCE)' END AS transformation, CASE o_orderkey % 3 WHEN 0 THEN 'AGGREGATE' ELSE 'DIRECT' END AS transformation_type, CAST(o_orderkey AS BIGINT) AS seq FROM orders
UNION ALL SELECT DISTINCT concat('O.', l_orderkey), 'TOTAL', concat('P.', l_partkey), 'PRICE', 'TOTAL * 2', 'EXPRESSION', CAST(0 AS BIGINT) FROM lineitem
UNION ALL SELECT concat('N.', c_nationkey), 'KEY', concat('C.', c_custkey), 'BALANCE', CAST(NULL AS STRING), 'DIRECT', CAST(c_custkey AS BIGINT) FROM customer
"""
_TRANSITIONS = """
SELECT DISTINCT event_type AS source_id, next AS target_id, 'ETL' AS dependency_type, 'SELECT' AS reference_type, CAST(0 AS BIGINT) AS seq
FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL
"""
_CHAINS = """
SELECT concat('E.', event_id) AS source_id, concat('E.', next) AS target_id, 'ETL' AS dependency_type, 'SELECT' AS reference_type, CAST(0 AS BIGINT) AS seq
FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL
"""
TABLES = ["region", "nation", "supplier", "customer", "orders", "part", "lineitem", "events"]


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _OBJECTS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _EDGES)


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _COLUMN_EDGES)


def _repeated(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The edges with repeats of equal rows, for what keeps one of each pair anyway: no shuffle to drop them first."""
    return _sql(spark, sf_dir, text.replace("SELECT DISTINCT", "SELECT"))


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, _EDGES)


def _version_of(spark: SparkSession, sf_dir: str) -> str:
    """What the tables of a folder hold now, by their files."""
    return fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])


def store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The stored graph of a folder's tables as they are now, made where the shared folder has none."""
    found = GraphStore(spark, f"{shared_dir(spark)}/graph-{_version_of(spark, sf_dir)}")
    return found if found.exists() else GraphStore.create(spark, found.path, objects(spark, sf_dir), repeated_edges(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> traverse.Snapshot:
    return store(spark, sf_dir).at(0).snapshot


_columns: dict = {}


def column_graph(spark: SparkSession, sf_dir: str) -> traverse.ColumnSnapshot:
    """Made once for each application and state of the tables, as long as its files are there."""
    key = (spark.sparkContext.applicationId, _version_of(spark, sf_dir))
    path, found = _columns.get(key, ("", None))
    if found is None or not exists(spark, path):
        found = traverse.column_snapshot(_repeated(spark, sf_dir, _COLUMN_EDGES))
        _columns[key] = (found.by_source.path, found)
    return found


def transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Objects and edges of the event types that follow one another: a graph with cycles and self-loops."""
    found = _sql(spark, sf_dir, _TRANSITIONS)
    names = _sql(spark, sf_dir, "SELECT DISTINCT event_type AS id FROM events")
    return names.select("id", F.lit("EVT").alias("schema"), F.col("id").alias("name"), F.lit("TABLE").alias("type")), found


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, edges and seeds of the chains of each user's events, from the first to the last; the seed is the first."""
    names = _sql(spark, sf_dir, "SELECT concat('E.', event_id) AS id FROM events")
    first = _sql(spark, sf_dir, "SELECT user_id, min_by(event_id, struct(ts, event_id)) AS e FROM events GROUP BY user_id")
    return names, _sql(spark, sf_dir, _CHAINS), first.select(F.concat(F.lit("E."), "e").alias("seed"), F.concat(F.lit("E."), "e").alias("id"))


def _duck(text: str) -> str:
    return text.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")


OBJECTS_SQL, EDGES_SQL, COLUMN_EDGES_SQL, TRANSITIONS_SQL = (_duck(t) for t in (_OBJECTS, _EDGES, _COLUMN_EDGES, _TRANSITIONS))
