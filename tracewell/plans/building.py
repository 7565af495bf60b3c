"""Queries that build and merge graphs. Their inputs are made from the keys of the tables, so the expected rows follow from the keys too."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions import formats, ids, sqltext
from tracewell.operators import bridge, build, merge, view
from tracewell.operators import catalog as operators_catalog
from tracewell.plans.derive import _sql
from tracewell.schemas import COLUMN_DEP, OBJECT, TABLE_DEP, conform
from tracewell.sources import cache, catalog, corpus
from tracewell.storage import new_path, shared_dir

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


VIEWS = """SELECT concat('DWH.V_', o_orderkey) AS id, concat('CREATE OR REPLACE VIEW DWH.V_', o_orderkey, ' AS SELECT c.NAME AS CNAME, SUM(o.AMT) AS TOTAL, CAST(o.DAY AS DATE) AS D, c.A || o.B AS AB, ',
'CASE WHEN o.S = 1 THEN c.X END AS FLAG FROM CRM.C_', o_custkey, ' c LEFT JOIN ORD.O_', o_orderkey, ' AS o ON c.ID = o.ID WHERE o.K > 3') AS definition, o_orderkey, o_custkey FROM orders"""
CATALOG = "SELECT concat('CRM.C_', c_custkey) AS id FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT concat('STG.O_', o_orderkey) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT concat('ORD.O_', o_orderkey) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT concat('DWH.V_', o_orderkey) FROM orders"
STATEMENTS = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat('INSERT INTO S.T_', o_orderkey, ' SELECT * FROM A.B_', o_custkey) WHEN 1 THEN concat('create table S.T_', o_orderkey, ' as select 1 from A.B_', o_custkey, ' where x in (select y from DUAL)')
WHEN 2 THEN concat('MERGE INTO S.T_', o_orderkey, ' USING A.B ON 1 = 1') WHEN 3 THEN concat('DELETE FROM S.T_', o_orderkey, '; UPDATE V_X SET a = 1') WHEN 4 THEN concat('TRUNCATE TABLE S.T_', o_orderkey, '; DROP TABLE T_', o_custkey) ELSE 'COMMIT' END AS sql, o_custkey AS c FROM orders"""
SCRIPTS = """SELECT concat('ETL.S_', o_orderkey) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'LUA' ELSE 'PYTHON' END AS script_language, CASE WHEN o_orderkey % 2 = 0
THEN concat('local r = query([[WITH w AS (SELECT 1 FROM CRM.C_', o_custkey, ') SELECT * FROM w]])\n', 'pquery("INSERT INTO " .. "STG.O_', o_orderkey, ' VALUES (1)")')
ELSE concat('run("SELECT a FROM CRM.C_', o_custkey, '")\n', 'run(f"UPDATE STG.O_', o_orderkey, ' SET x = {v}")') END AS script_text, o_orderkey, o_custkey FROM orders"""
SYNC = """SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('b', o_custkey) END AS batch_name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('t', o_orderkey) END AS task_name, 'FULL' AS table_type,
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'p' END AS bq_project_id, 'd' AS bq_dataset_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('tab', o_orderkey) END AS bq_table_name, 'STG' AS exa_stg_schema_name,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('s', o_orderkey) END AS exa_stg_table_name, 'DM' AS exa_dm_schema_name, concat('m', o_orderkey) AS exa_dm_table_name, 'N' AS is_snapshot FROM orders"""
BASE = "SELECT concat('C.', c_custkey) AS id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'exasol' ELSE 'bridge' END AS platform, CAST(c_custkey AS BIGINT) AS object_id FROM customer WHERE c_custkey % 5 <> 0"
NEW = "SELECT concat('C.', c_custkey) AS id, c_mktsegment AS description, 'bigquery' AS platform, CAST(c_custkey + 1000000 AS BIGINT) AS object_id FROM customer WHERE c_custkey % 4 <> 0"
BASE_DEPS = "SELECT concat('N.', c_nationkey) AS source_id, concat('C.', c_custkey) AS target_id, 'ETL' AS dependency_type, 'SELECT' AS reference_type, CAST(c_custkey AS BIGINT) AS seq FROM customer WHERE c_custkey % 2 = 0"
NEW_DEPS = "SELECT concat('N.', c_nationkey) AS source_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('C.', c_custkey) END AS target_id, 'SYNC' AS dependency_type, 'NEW' AS reference_type, CAST(c_custkey AS BIGINT) AS seq FROM customer WHERE c_custkey % 3 = 0"


@query(f"""WITH s AS ({STATEMENTS})
SELECT k, 'S' AS ref_schema, concat('T_', k) AS ref_name, CASE k % 6 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DDL' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'SELECT' ELSE 'DDL' END AS reference_type, k % 6 <> 3 AS is_target FROM s WHERE k % 6 < 5
UNION ALL SELECT k, 'A', concat('B_', c), 'SELECT', false FROM s WHERE k % 6 < 2
UNION ALL SELECT k, NULL, concat('T_', c), 'DDL', true FROM s WHERE k % 6 = 4""")
def sql_refs(spark, sf_dir):
    return sqltext.table_refs(_sql(spark, sf_dir, STATEMENTS), ["k"], "sql")


@query(f"""WITH v AS ({VIEWS}) SELECT id, 'CRM' AS ref_schema, concat('C_', o_custkey) AS ref_name, 'SELECT' AS reference_type FROM v UNION ALL SELECT id, 'ORD', concat('O_', o_orderkey), 'JOIN' FROM v""")
def view_refs(spark, sf_dir):
    return sqltext.table_refs(_sql(spark, sf_dir, VIEWS), ["id"], "definition").select("id", "ref_schema", "ref_name", "reference_type")


@query(f"WITH v AS ({VIEWS}) SELECT id, concat('DWH.V_', o_orderkey) AS full_name, 'VIEW' AS object_type, concat('V_', o_orderkey) AS name FROM v")
def create_target(spark, sf_dir):
    return _sql(spark, sf_dir, VIEWS).select("id", sqltext.create_target(F.col("definition")).alias("t")).select("id", "t.*")


@query(f"WITH v AS ({VIEWS}) SELECT id, substr(definition, strpos(definition, ' AS SELECT') + 4) AS query FROM v")
def clean_sql(spark, sf_dir):
    return _sql(spark, sf_dir, VIEWS).select("id", sqltext.clean_view(F.col("definition")).alias("query"))


@query(f"""WITH v AS ({VIEWS}), e AS (SELECT *, concat('CRM.C_', o_custkey) AS c, concat('ORD.O_', o_orderkey) AS o FROM v)
SELECT id, c AS source_object_id, 'NAME' AS source_column, 'CNAME' AS target_column, NULL AS transformation, 'DIRECT' AS transformation_type FROM e
UNION ALL SELECT id, o, 'AMT', 'TOTAL', 'SUM(o.AMT)', 'AGGREGATE' FROM e UNION ALL SELECT id, o, 'DAY', 'D', 'CAST(o.DAY AS DATE)', 'CAST' FROM e
UNION ALL SELECT id, c, 'A', 'AB', 'c.A || o.B', 'EXPRESSION' FROM e UNION ALL SELECT id, o, 'B', 'AB', 'c.A || o.B', 'EXPRESSION' FROM e
UNION ALL SELECT id, o, 'S', 'FLAG', 'CASE WHEN o.S = 1 THEN c.X END', 'CASE' FROM e UNION ALL SELECT id, c, 'X', 'FLAG', 'CASE WHEN o.S = 1 THEN c.X END', 'CASE' FROM e""")
def column_lineage(spark, sf_dir):
    return sqltext.column_lineage(_sql(spark, sf_dir, VIEWS), "id", "definition")


_RESOLVED = f"""WITH v AS ({VIEWS}), cat AS ({CATALOG}), r AS (SELECT id, concat('C_', o_custkey) AS n, concat('CRM.C_', o_custkey) AS w FROM v UNION ALL SELECT id, concat('O_', o_orderkey), concat('ORD.O_', o_orderkey) FROM v),
found AS (SELECT r.id, r.w, coalesce((SELECT min(cat.id) FROM cat WHERE cat.id = r.w), (SELECT min(cat.id) FROM cat WHERE split_part(cat.id, '.', 2) = r.n)) AS object_id FROM r)"""


@query(f"{_RESOLVED} SELECT id, w AS wanted, object_id FROM found")
def resolve_refs(spark, sf_dir):
    refs = sqltext.table_refs(_sql(spark, sf_dir, VIEWS), ["id"], "definition")
    return build.resolve(refs, _sql(spark, sf_dir, CATALOG)).select("id", F.concat_ws(".", "ref_schema", "ref_name").alias("wanted"), "object_id")


@query(f"{_RESOLVED} SELECT object_id AS source_id, id AS target_id, 'VIEW' AS dependency_type, min(CASE WHEN w LIKE 'CRM.%' THEN 'SELECT' ELSE 'JOIN' END) AS reference_type FROM found WHERE object_id IS NOT NULL GROUP BY object_id, id")
def view_deps(spark, sf_dir):
    return build.view_dependencies(_sql(spark, sf_dir, VIEWS), _sql(spark, sf_dir, CATALOG))


@query(f"""WITH s AS ({SCRIPTS}), cat AS ({CATALOG}), r AS (SELECT id, concat('CRM.C_', o_custkey) AS t, 'SELECT' AS k FROM s UNION ALL SELECT id, concat('STG.O_', o_orderkey), CASE WHEN o_orderkey % 2 = 0 THEN 'INSERT' ELSE 'UPDATE' END FROM s)
SELECT CASE WHEN k = 'SELECT' THEN t ELSE r.id END AS source_id, CASE WHEN k = 'SELECT' THEN r.id ELSE t END AS target_id, CASE WHEN k = 'SELECT' THEN 'UDF_INPUT' ELSE 'UDF_OUTPUT' END AS dependency_type, k AS reference_type
FROM r JOIN cat ON cat.id = t""")
def script_deps(spark, sf_dir):
    return build.script_dependencies(_sql(spark, sf_dir, SCRIPTS), _sql(spark, sf_dir, CATALOG))


@query(f"""{_RESOLVED} SELECT DISTINCT w AS id, split_part(w, '.', 1) AS schema, split_part(w, '.', 2) AS name, 'BIGQUERY_TABLE' AS type, 'External reference' AS description FROM found WHERE w NOT IN (SELECT id FROM cat)""")
def external_placeholders(spark, sf_dir):
    refs = sqltext.table_refs(_sql(spark, sf_dir, VIEWS), ["id"], "definition").select(F.concat_ws(".", "ref_schema", "ref_name").alias("id"))
    return build.placeholders(refs, _sql(spark, sf_dir, CATALOG))


SYSTEM = """SELECT 'CRM' AS REFERENCED_OBJECT_SCHEMA, concat('C_', o_custkey) AS REFERENCED_OBJECT_NAME, 'DWH' AS OBJECT_SCHEMA, concat('V_', o_orderkey) AS OBJECT_NAME,
CASE o_orderkey % 3 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'UDF SCRIPT' ELSE 'TABLE' END AS OBJECT_TYPE, CASE o_orderkey % 2 WHEN 0 THEN '' ELSE 'JOIN' END AS REFERENCE_TYPE FROM orders"""


@query(f"""WITH s AS ({SYSTEM}), cat AS ({CATALOG}) SELECT concat('CRM.', REFERENCED_OBJECT_NAME) AS source_id, concat('DWH.', OBJECT_NAME) AS target_id,
CASE WHEN OBJECT_TYPE = 'VIEW' THEN 'VIEW' WHEN OBJECT_TYPE LIKE '%SCRIPT%' THEN 'UDF_INPUT' ELSE 'ETL' END AS dependency_type, coalesce(nullif(REFERENCE_TYPE, ''), 'SELECT') AS reference_type
FROM s WHERE concat('CRM.', REFERENCED_OBJECT_NAME) IN (SELECT id FROM cat)""")
def dep_typing(spark, sf_dir):
    return build.catalog_dependencies(_sql(spark, sf_dir, SYSTEM), _sql(spark, sf_dir, CATALOG))


ROUTINES = "SELECT concat('bigquery:p.d.r', c_custkey) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'BIGQUERY_PROCEDURE' ELSE 'BIGQUERY_VIEW' END AS type, concat('INSERT INTO d.t', c_nationkey, ' SELECT 1 FROM d.s', c_custkey) AS definition, c_custkey, c_nationkey FROM customer"


@query(f"""WITH r AS ({ROUTINES}) SELECT CASE WHEN c_custkey % 2 = 0 THEN id ELSE concat('bigquery:p.D.T', c_nationkey) END AS source_id, CASE WHEN c_custkey % 2 = 0 THEN concat('bigquery:p.D.T', c_nationkey) ELSE id END AS target_id,
CASE WHEN c_custkey % 2 = 0 THEN 'WRITES' ELSE 'USES' END AS dependency_type, 'INSERT' AS reference_type FROM r UNION ALL SELECT concat('bigquery:p.D.S', c_custkey), id, 'USES', 'SELECT' FROM r""")
def warehouse_deps(spark, sf_dir):
    return build.warehouse_dependencies(_sql(spark, sf_dir, ROUTINES), "p", "d")[0]


DAGS = """SELECT concat('dag', c_custkey) AS dag_id, concat('["p.d.a', c_nationkey, '", "p.d.b', c_custkey, '"]') AS source_tables, CASE WHEN c_custkey % 2 = 0 THEN concat('["p.d.z', c_custkey, '"]') ELSE 'none' END AS target_tables, c_custkey, c_nationkey FROM customer"""


@query(f"""WITH d AS ({DAGS}) SELECT concat('bigquery:p.d.a', c_nationkey) AS source_id, concat('composer:', dag_id) AS target_id, 'READS' AS dependency_type, 'DAG_INPUT' AS reference_type FROM d
UNION ALL SELECT concat('bigquery:p.d.b', c_custkey), concat('composer:', dag_id), 'READS', 'DAG_INPUT' FROM d UNION ALL SELECT concat('composer:', dag_id), concat('bigquery:p.d.z', c_custkey), 'WRITES', 'DAG_OUTPUT' FROM d WHERE c_custkey % 2 = 0""")
def dag_edges(spark, sf_dir):
    return build.dag_dependencies(_sql(spark, sf_dir, DAGS), _sql(spark, sf_dir, CATALOG))[0]


_SYNC = f"""WITH s AS (SELECT DISTINCT *, upper(concat('BIGQUERY.', CASE WHEN bq_project_id IS NULL THEN '' ELSE bq_project_id || '.' END, bq_dataset_id, '.', bq_table_name)) AS src, upper('STG.' || exa_stg_table_name) AS stg, upper('DM.' || exa_dm_table_name) AS dm FROM ({SYNC}) WHERE bq_table_name IS NOT NULL),
r AS (SELECT *, CASE WHEN stg IS NOT NULL THEN CASE WHEN batch_name <> '' THEN upper(concat('SYNC.', batch_name, '.', coalesce(task_name, 'None'))) ELSE 'SYNC.' || src END END AS job FROM s)"""


@query(f"""{_SYNC} SELECT src AS source_id, job AS target_id, 'SYNC' AS dependency_type, 'BQ_TO_SYNC' AS reference_type FROM r WHERE stg IS NOT NULL UNION ALL SELECT job, stg, 'SYNC', 'SYNC_TO_EXASOL' FROM r WHERE stg IS NOT NULL
UNION ALL SELECT stg, dm, 'ETL', 'STG_TO_DM' FROM r WHERE stg IS NOT NULL UNION ALL SELECT src, dm, 'SYNC', 'BQ_TO_EXASOL' FROM r WHERE stg IS NULL""")
def bridge_edges(spark, sf_dir):
    return bridge.bridge_edges(_sql(spark, sf_dir, SYNC))


@query(f"""{_SYNC} SELECT DISTINCT id, schema, name, type, platform FROM (SELECT src AS id, CASE WHEN bq_project_id IS NULL THEN 'D' ELSE 'P.D' END AS schema, upper(bq_table_name) AS name, 'BIGQUERY_TABLE' AS type, 'bigquery' AS platform FROM r
UNION ALL SELECT stg, 'STG', upper(exa_stg_table_name), 'TABLE', 'exasol' FROM r WHERE stg IS NOT NULL UNION ALL SELECT dm, 'DM', upper(exa_dm_table_name), 'TABLE', 'exasol' FROM r
UNION ALL SELECT job, 'SYNC', coalesce(nullif(task_name, ''), nullif(batch_name, ''), concat('SYNC_', bq_table_name)), 'SYNC_JOB', 'bridge' FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY concat_ws(chr(1), batch_name, coalesce(task_name, ''), table_type, coalesce(bq_project_id, ''), bq_dataset_id, bq_table_name)) AS n FROM r WHERE job IS NOT NULL) WHERE n = 1)""")
def bridge_objects(spark, sf_dir):
    return bridge.bridge_objects(_sql(spark, sf_dir, SYNC)).select("id", "schema", "name", "type", "platform")


@query(f"""WITH b AS ({BASE}), n AS ({NEW}) SELECT coalesce(b.id, n.id) AS id, CASE WHEN coalesce(b.description, '') = '' THEN coalesce(n.description, b.description) ELSE b.description END AS description, coalesce(b.platform, n.platform) AS platform, coalesce(b.object_id, n.object_id) AS object_id,
CASE WHEN b.platform = 'exasol' THEN n.platform END AS source_platform, b.id IS NULL AS added, b.id IS NOT NULL AND n.id IS NOT NULL AS enriched FROM b FULL JOIN n ON b.id = n.id""")
def merge_enrich(spark, sf_dir):
    return merge.enrich_objects(_sql(spark, sf_dir, BASE), _sql(spark, sf_dir, NEW))


# Both sides list some objects again; the last holds.
BASE_AGAIN = f"{BASE} UNION ALL SELECT concat('C.', c_custkey), concat('again ', c_name), 'exasol', CAST(c_custkey + 500 AS BIGINT) FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT concat('C.', c_custkey), 'never', 'exasol', CAST(c_custkey - 1000 AS BIGINT) FROM customer WHERE c_custkey % 10 = 2"
NEW_AGAIN = f"{NEW} UNION ALL SELECT concat('C.', c_custkey), 'newer', 'composer', CAST(c_custkey + 2000000 AS BIGINT) FROM customer WHERE c_custkey % 6 = 0"


@query(f"""WITH b AS (SELECT id, arg_max(struct_pack(d := description, p := platform, o := object_id), object_id) AS r FROM ({BASE_AGAIN}) GROUP BY id),
n AS (SELECT id, arg_max(struct_pack(d := description, p := platform, o := object_id), object_id) AS r FROM ({NEW_AGAIN}) GROUP BY id)
SELECT coalesce(b.id, n.id) AS id, CASE WHEN coalesce(b.r.d, '') = '' THEN coalesce(n.r.d, b.r.d) ELSE b.r.d END AS description, coalesce(b.r.p, n.r.p) AS platform, coalesce(b.r.o, n.r.o) AS object_id,
       b.id IS NULL AS added, b.id IS NOT NULL AND n.id IS NOT NULL AS enriched FROM b FULL JOIN n ON b.id = n.id""")
def merge_repeats(spark, sf_dir):
    merged = merge.enrich_objects(_sql(spark, sf_dir, BASE_AGAIN), _sql(spark, sf_dir, NEW_AGAIN))
    return merged.select("id", "description", "platform", "object_id", "added", "enriched")


@query(f"WITH b AS ({BASE_DEPS}), n AS ({NEW_DEPS}) SELECT * FROM b UNION ALL SELECT * FROM n WHERE target_id IS NOT NULL AND (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM b)")
def merge_deps(spark, sf_dir):
    return merge.append_new(_sql(spark, sf_dir, BASE_DEPS), _sql(spark, sf_dir, NEW_DEPS), merge.EDGE_KEY)


@query(f"WITH b AS ({BASE}), n AS ({NEW}) SELECT 'exasol:' || id AS id, description, platform, object_id FROM b UNION ALL SELECT id, description, platform, object_id FROM n")
def merge_prefix(spark, sf_dir):
    b, n = _sql(spark, sf_dir, BASE), _sql(spark, sf_dir, NEW)
    return merge.merge_platforms(b, _sql(spark, sf_dir, BASE_DEPS), n, _sql(spark, sf_dir, NEW_DEPS))[0]


@query(f"WITH b AS ({BASE_DEPS}), n AS ({NEW_DEPS}) SELECT 'exasol:' || source_id AS source_id, 'exasol:' || target_id AS target_id, dependency_type, reference_type, seq FROM b UNION ALL SELECT * FROM n")
def merge_prefix_deps(spark, sf_dir):
    b, n = _sql(spark, sf_dir, BASE), _sql(spark, sf_dir, NEW)
    return merge.merge_platforms(b, _sql(spark, sf_dir, BASE_DEPS), n, _sql(spark, sf_dir, NEW_DEPS))[1]


@query(f"WITH b AS ({BASE}), n AS ({NEW}) SELECT id, description, platform, object_id FROM b UNION ALL SELECT id, description, platform, object_id FROM n WHERE id NOT IN (SELECT id FROM b)")
def merge_first_wins(spark, sf_dir):
    b, n = _sql(spark, sf_dir, BASE), _sql(spark, sf_dir, NEW)
    return merge.merge_first(b, _sql(spark, sf_dir, BASE_DEPS), n, _sql(spark, sf_dir, NEW_DEPS))[0]


PARAMS = "SELECT p_partkey, concat('INT, ', CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ',VARCHAR ') AS t, p_brand, p_size FROM part"


@query(f"WITH p AS ({PARAMS}) SELECT p_partkey, concat('param_1=INT', CASE WHEN p_size % 2 = 0 THEN '' ELSE concat(';param_2=', p_brand) END, ';param_3=VARCHAR') AS params FROM p")
def parameter_lists(spark, sf_dir):
    lists = ids.type_list(F.col("t"), "param")
    return _sql(spark, sf_dir, PARAMS).select("p_partkey", F.array_join(F.transform(lists, lambda m: F.concat_ws("=", m["name"], m["data_type"])), ";").alias("params"))


TABLES = "SELECT 'CRM' AS TABLE_SCHEMA, c_name AS TABLE_NAME, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'OWN' END AS TABLE_OWNER, c_mktsegment AS TABLE_COMMENT, CAST(c_custkey AS BIGINT) AS TABLE_ROW_COUNT, CAST(c_custkey AS BIGINT) AS TABLE_OBJECT_ID FROM customer"
COLUMNS = "SELECT 'CRM' AS COLUMN_SCHEMA, c_name AS COLUMN_TABLE, concat('COL', o_orderkey) AS COLUMN_NAME, 'INT' AS COLUMN_TYPE, o_orderkey AS COLUMN_ORDINAL_POSITION, true AS COLUMN_IS_NULLABLE, CAST(NULL AS VARCHAR(9)) AS COLUMN_COMMENT FROM (SELECT * FROM orders) JOIN (SELECT * FROM customer) ON o_custkey = c_custkey"


@query(f"""WITH t AS ({TABLES}), c AS ({COLUMNS}) SELECT concat('CRM.', TABLE_NAME) AS id, coalesce(nullif(TABLE_OWNER, ''), 'SYS') AS owner, TABLE_OBJECT_ID AS object_id,
coalesce((SELECT string_agg(COLUMN_NAME, ',' ORDER BY COLUMN_ORDINAL_POSITION) FROM c WHERE COLUMN_TABLE = TABLE_NAME), '') AS columns FROM t""")
def catalog_tables(spark, sf_dir):
    found = catalog.tables(_sql(spark, sf_dir, TABLES), _sql(spark, sf_dir, COLUMNS))
    return found.select("id", "owner", "object_id", F.array_join("columns.name", ",").alias("columns"))


@query(f"""WITH b AS ({BASE}), n AS ({NEW}), bd AS ({BASE_DEPS}), nd AS ({NEW_DEPS}) SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM b)) AS added_objects, (SELECT count(*) FROM n WHERE id IN (SELECT id FROM b)) AS enriched_objects,
(SELECT count(*) FROM nd WHERE target_id IS NOT NULL AND (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM bd)) AS added_dependencies""")
def merge_counters(spark, sf_dir):
    before = _sql(spark, sf_dir, BASE_DEPS)
    merged = merge.append_new(before, _sql(spark, sf_dir, NEW_DEPS), merge.EDGE_KEY)
    return merge.merge_counters(merge.enrich_objects(_sql(spark, sf_dir, BASE), _sql(spark, sf_dir, NEW)), before, merged)


@query(f"WITH t AS ({TABLES}), c AS ({COLUMNS}), d AS ({BASE_DEPS}) SELECT (SELECT count(*) FROM t) AS object_count, (SELECT count(*) FROM c) AS column_count, (SELECT count(*) FROM d) AS dependency_count")
def cache_counters(spark, sf_dir):
    return operators_catalog.cache_counters(catalog.tables(_sql(spark, sf_dir, TABLES), _sql(spark, sf_dir, COLUMNS)), _sql(spark, sf_dir, BASE_DEPS))


REFERENCES = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('`q.e.t', c_custkey, '`') WHEN 1 THEN concat('e.`t', c_custkey, '`') ELSE concat('t', c_custkey) END AS r FROM customer"


@query(f"WITH r AS ({REFERENCES}) SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN 'bigquery:q.e.t' WHEN 1 THEN 'bigquery:p.e.t' ELSE 'bigquery:p.d.t' END, c_custkey) AS id FROM r")
def reference_ids(spark, sf_dir):
    return _sql(spark, sf_dir, REFERENCES).select("c_custkey", ids.reference_id(F.col("r"), F.lit("p"), F.lit("d")).alias("id"))


MAPPINGS = "SELECT concat('p.d.TAB', o_orderkey) AS bq_full_name, concat('a', o_custkey) AS bq_col, concat('X', o_custkey) AS exa_col FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""{_SYNC}, m AS ({MAPPINGS}) SELECT src AS source_object_id, bq_col AS source_column, coalesce(stg, dm) AS target_object_id, exa_col AS target_column, NULL AS transformation, 'DIRECT' AS transformation_type
FROM r JOIN m ON upper(m.bq_full_name) = replace(src, 'BIGQUERY.', '')""")
def bridge_columns(spark, sf_dir):
    return bridge.bridge_columns(_sql(spark, sf_dir, SYNC), _sql(spark, sf_dir, MAPPINGS))


NAMED = """SELECT concat('N.', n_nationkey) AS id, 'TABLE' AS type, CAST(NULL AS VARCHAR(99)) AS definition, concat('KEY', n_nationkey) AS column_name FROM nation
UNION ALL SELECT concat('C.', c_custkey), 'VIEW', concat('select key', c_nationkey, ' from x'), concat('Key', c_custkey) FROM customer"""


@query(f"""WITH o AS ({NAMED}), d AS ({BASE_DEPS}) SELECT s.id AS source_object_id, s.column_name AS source_column, t.id AS target_object_id, t.column_name AS target_column, NULL AS transformation, 'UNKNOWN' AS transformation_type
FROM d JOIN o s ON s.id = d.source_id JOIN o t ON t.id = d.target_id AND t.type = 'VIEW' WHERE upper(s.column_name) = upper(t.column_name) OR contains(upper(t.definition), upper(s.column_name))""")
def columns_by_name(spark, sf_dir):
    objects = _sql(spark, sf_dir, NAMED).withColumn("columns", F.array(F.struct(F.col("column_name").alias("name"))))
    return build.columns_by_name(_sql(spark, sf_dir, BASE_DEPS), objects)


WAREHOUSE = "SELECT 'p' AS project_id, 'd' AS dataset_id, c_name AS table_name, CASE WHEN c_custkey % 4 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS creation_time FROM customer"
WAREHOUSE_COLUMNS = "SELECT 'p' AS project_id, 'd' AS dataset_id, c_name AS table_name, concat('f', o_orderkey) AS column_name, o_orderkey AS ordinal_position, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable, 'INT64' AS data_type FROM (SELECT * FROM orders) JOIN (SELECT * FROM customer) ON o_custkey = c_custkey"


@query(f"""WITH t AS ({WAREHOUSE}), c AS ({WAREHOUSE_COLUMNS}) SELECT concat('bigquery:p.d.', table_name) AS id, 'p.d' AS schema, table_name AS name,
coalesce((SELECT string_agg(concat(column_name, CASE WHEN is_nullable = 'YES' THEN '?' ELSE '' END), ',' ORDER BY ordinal_position) FROM c WHERE c.table_name = t.table_name), '') AS columns FROM t WHERE table_type = 'BASE TABLE'""")
def warehouse_tables(spark, sf_dir):
    found = catalog.warehouse_tables(_sql(spark, sf_dir, WAREHOUSE), _sql(spark, sf_dir, WAREHOUSE_COLUMNS))
    shown = F.transform("columns", lambda c: F.concat(c["name"], F.when(c["is_nullable"], "?").otherwise("")))
    return found.select("id", "schema", "name", F.array_join(shown, ",").alias("columns"))


METADATA = "SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS s, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'select 1' END AS a, p_type AS b, p_size FROM part"


@query(f"WITH m AS ({METADATA}) SELECT concat(coalesce(s, 'METADATA'), '.', p_name) AS id, 'VIEW' AS type, CASE WHEN a = '' THEN b ELSE concat(a, chr(10), b) END AS definition FROM m WHERE p_size > 10")
def metadata_scripts(spark, sf_dir):
    found = catalog.metadata_scripts(_sql(spark, sf_dir, METADATA), "p_partkey", "p_name", ["a", "b"], "s", "p_size > 10")
    return found.select("id", "type", "definition")


@query(f"WITH d AS ({DAGS}), e AS (SELECT concat('p.d.a', c_nationkey) AS n FROM d UNION SELECT concat('p.d.b', c_custkey) FROM d UNION SELECT concat('p.d.z', c_custkey) FROM d WHERE c_custkey % 2 = 0) SELECT concat('bigquery:', n) AS id, 'p.d' AS schema, split_part(n, '.', 3) AS name, 'BIGQUERY_TABLE' AS type, 'External reference' AS description FROM e")
def dag_placeholders(spark, sf_dir):
    return build.dag_dependencies(_sql(spark, sf_dir, DAGS), _sql(spark, sf_dir, CATALOG))[1]


# Texts of many shapes: quoted and three-part names, comments, literals, comma joins, EXTRACT, subqueries, several statements.
HARD = """SELECT c_custkey AS k, CASE c_custkey % 10
WHEN 0 THEN concat('SELECT EXTRACT(YEAR FROM o.D), TRIM(LEADING FROM b.X) FROM S.A_', c_custkey, ' o, S.B_', c_nationkey, ' b WHERE o.ID = b.ID')
WHEN 1 THEN concat('-- FROM S.COMMENTED\nSELECT ''FROM S.QUOTED'' FROM "S"."A_', c_custkey, '" /* JOIN S.GONE */ JOIN S.B_', c_nationkey, ' ON 1 = 1')
WHEN 2 THEN concat('WITH q AS (SELECT * FROM S.A_', c_custkey, '), r (x) AS (SELECT 1) SELECT * FROM q, r JOIN (SELECT 1 FROM S.B_', c_nationkey, ') z ON q.x = z.x')
WHEN 3 THEN concat('SELECT * FROM S.A_', c_custkey, ' a WHERE a.x IN (SELECT f(y, z) FROM S.B_', c_nationkey, ', S.C_1) AND a.p IS DISTINCT FROM a.q')
WHEN 4 THEN concat('INSERT INTO S.A_', c_custkey, ' (x, y) SELECT g(a, b), c FROM S.B_', c_nationkey, ', UNNEST(arr) u; DROP TABLE IF EXISTS S.C_1')
WHEN 5 THEN concat('CREATE TABLE IF NOT EXISTS S.A_', c_custkey, ' AS SELECT CASE WHEN x = ''it''''s (not'' THEN 1 END FROM S.B_', c_nationkey, ' b LEFT JOIN S.C_1 c USING (k), S.D_1')
WHEN 6 THEN concat('MERGE INTO S.A_', c_custkey, ' t USING S.B_', c_nationkey, ' s ON t.k = s.k WHEN MATCHED THEN UPDATE SET x = 1')
WHEN 7 THEN concat('UPDATE S.A_', c_custkey, ' SET x = (SELECT MAX(y) FROM S.B_', c_nationkey, ') WHERE v_z = 1; DELETE FROM S.C_1 WHERE k = 2')
WHEN 8 THEN concat('SELECT * FROM (SELECT x FROM S.A_', c_custkey, ' UNION ALL SELECT x FROM S.B_', c_nationkey, ') u ORDER BY x, S.NOT_A_TABLE')
ELSE concat('SELECT x FROM S.A_', c_custkey, ' JOIN SUM JOIN S.B_', c_nationkey, ' ON a(b, c), S.C_1 CROSS JOIN S.D_1 FOR UPDATE') END AS sql, c_nationkey AS n FROM customer"""


@query(f"""WITH h AS ({HARD}), a AS (SELECT k, concat('A_', k) AS ref_name, CASE k % 10 WHEN 4 THEN 'INSERT' WHEN 5 THEN 'DDL' WHEN 6 THEN 'INSERT' WHEN 7 THEN 'UPDATE' ELSE 'SELECT' END AS reference_type FROM h),
b AS (SELECT k, concat('B_', n) AS ref_name, CASE WHEN k % 10 IN (1, 9) THEN 'JOIN' ELSE 'SELECT' END AS reference_type FROM h WHERE k % 10 <> 6),
c AS (SELECT k, 'C_1' AS ref_name, CASE k % 10 WHEN 4 THEN 'DDL' WHEN 5 THEN 'JOIN' ELSE 'SELECT' END AS reference_type FROM h WHERE k % 10 IN (3, 4, 5, 7, 9)),
d AS (SELECT k, 'D_1' AS ref_name, CASE k % 10 WHEN 5 THEN 'SELECT' ELSE 'JOIN' END AS reference_type FROM h WHERE k % 10 IN (5, 9)),
r AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
SELECT k, 'S' AS ref_schema, ref_name, reference_type, reference_type IN ('INSERT', 'UPDATE', 'DDL') AS is_target FROM r""")
def sql_refs_hard(spark, sf_dir):
    return sqltext.table_refs(_sql(spark, sf_dir, HARD), ["k"], "sql")


@query(f"""WITH h AS ({HARD}) SELECT k, concat('A_', k) AS ref_name, CASE k % 10 WHEN 6 THEN 'MERGE' ELSE 'UPDATE' END AS reference_type FROM h WHERE k % 10 IN (6, 7)
UNION ALL SELECT k, concat('B_', n), 'SELECT' FROM h WHERE k % 10 IN (6, 7) UNION ALL SELECT k, 'C_1', 'DELETE' FROM h WHERE k % 10 = 7""")
def sql_refs_by_statement(spark, sf_dir):
    rows = _sql(spark, sf_dir, HARD).where("k % 10 IN (6, 7)")
    return sqltext.table_refs(rows, ["k"], "sql", by_statement=True).select("k", "ref_name", "reference_type")


HARD_VIEWS = """SELECT concat('DWH.H_', c_custkey) AS id, CASE c_custkey % 6
WHEN 0 THEN concat('SELECT EXTRACT(YEAR FROM o.D) AS Y, o.A || '', x'' AS AB FROM S.A_', c_custkey, ' o')
WHEN 1 THEN concat('CREATE VIEW DWH.H AS SELECT F(G(H(I(o.A, 1), 2), 3), o.B) AS DEEP, o.C c2 -- o.GONE AS X,\n FROM S.A_', c_custkey, ' AS o')
WHEN 2 THEN concat('SELECT (SELECT MAX(i.X) FROM S.I_1 i WHERE i.K = o.K) AS M, t.A B, COUNT(DISTINCT o.Z) FROM S.A_', c_custkey, ' o, T.B_', c_nationkey, ' t')
WHEN 3 THEN concat('WITH w AS (SELECT q.N FROM S.Q_1 q) SELECT DISTINCT w.N, "o"."Mixed" AS "Named", o.P + 1 FROM w JOIN S.A_', c_custkey, ' o ON w.N = o.N')
WHEN 4 THEN concat('SELECT CASE WHEN o.S = '',('' THEN o.T ELSE NULL END, -o.N AS NEG, SAFE_CAST(o.V AS INT64) AS V FROM `p.d.A_', c_custkey, '` o')
ELSE concat('SELECT A_', c_custkey, '.X, o.* FROM S.A_', c_custkey, ' UNION ALL SELECT z.Y FROM S.Z_1 z') END AS definition, c_custkey AS k, c_nationkey AS n FROM customer"""


@query(f"""WITH h AS ({HARD_VIEWS}), e(m, src, col, tgt, txt, kind) AS (VALUES
(0, 'A', 'D', 'Y', 'EXTRACT(YEAR FROM o.D)', 'FUNCTION'), (0, 'A', 'A', 'AB', 'o.A || '', x''', 'EXPRESSION'),
(1, 'A', 'A', 'DEEP', 'F(G(H(I(o.A, 1), 2), 3), o.B)', 'FUNCTION'), (1, 'A', 'B', 'DEEP', 'F(G(H(I(o.A, 1), 2), 3), o.B)', 'FUNCTION'), (1, 'A', 'C', 'C2', NULL, 'DIRECT'),
(2, 'S.I_1', 'X', 'M', '(SELECT MAX(i.X) FROM S.I_1 i WHERE i.K = o.K)', 'UNKNOWN'), (2, 'S.I_1', 'K', 'M', '(SELECT MAX(i.X) FROM S.I_1 i WHERE i.K = o.K)', 'UNKNOWN'),
(2, 'A', 'K', 'M', '(SELECT MAX(i.X) FROM S.I_1 i WHERE i.K = o.K)', 'UNKNOWN'), (2, 'B', 'A', 'B', NULL, 'DIRECT'), (2, 'A', 'Z', 'COUNT(DISTINCT O.Z)', 'COUNT(DISTINCT o.Z)', 'AGGREGATE'),
(3, 'W', 'N', 'N', NULL, 'DIRECT'), (3, 'A', 'MIXED', 'NAMED', NULL, 'DIRECT'), (3, 'A', 'P', 'O.P + 1', 'o.P + 1', 'EXPRESSION'),
(4, 'P', 'S', 'CASE WHEN O.S = '',('' THEN O.T ELSE NULL END', 'CASE WHEN o.S = '',('' THEN o.T ELSE NULL END', 'CASE'), (4, 'P', 'T', 'CASE WHEN O.S = '',('' THEN O.T ELSE NULL END', 'CASE WHEN o.S = '',('' THEN o.T ELSE NULL END', 'CASE'),
(4, 'P', 'N', 'NEG', '-o.N', 'UNKNOWN'), (4, 'P', 'V', 'V', 'SAFE_CAST(o.V AS INT64)', 'CAST'),
(5, 'A', 'X', 'X', NULL, 'DIRECT'), (5, 'O', '*', '*', NULL, 'DIRECT'))
SELECT id, CASE src WHEN 'A' THEN concat('S.A_', k) WHEN 'B' THEN concat('T.B_', n) WHEN 'P' THEN concat('P.D.A_', k) ELSE src END AS source_object_id, col AS source_column, tgt AS target_column, txt AS transformation, kind AS transformation_type
FROM h JOIN e ON m = k % 6""")
def column_lineage_hard(spark, sf_dir):
    return sqltext.column_lineage(_sql(spark, sf_dir, HARD_VIEWS), "id", "definition")


HARD_ROUTINES = """SELECT concat('bigquery:p.d.v', c_custkey) AS id, 'BIGQUERY_VIEW' AS type, concat('SELECT * FROM `p.d.v', c_custkey + 1, '` JOIN p.d.V', c_custkey + 2, ' ON 1 = 1, e.t', c_nationkey, ' JOIN my-project.e.t', c_nationkey, ' -- JOIN d.gone') AS definition, c_custkey, c_nationkey FROM customer"""


@query(f"""WITH r AS ({HARD_ROUTINES}), top AS (SELECT max(c_custkey) AS m FROM r), e AS (
SELECT CASE WHEN c_custkey + 1 <= m THEN concat('bigquery:p.d.v', c_custkey + 1) ELSE concat('bigquery:P.D.V', c_custkey + 1) END AS source_id, id AS target_id, 'SELECT' AS reference_type FROM r, top
UNION ALL SELECT CASE WHEN c_custkey + 2 <= m THEN concat('bigquery:p.d.v', c_custkey + 2) ELSE concat('bigquery:P.D.V', c_custkey + 2) END, id, 'JOIN' FROM r, top
UNION ALL SELECT concat('bigquery:p.E.T', c_nationkey), id, 'SELECT' FROM r UNION ALL SELECT concat('bigquery:MY-PROJECT.E.T', c_nationkey), id, 'JOIN' FROM r)
SELECT source_id, target_id, 'USES' AS dependency_type, reference_type FROM e""")
def warehouse_deps_hard(spark, sf_dir):
    return build.warehouse_dependencies(_sql(spark, sf_dir, HARD_ROUTINES), "p", "d")[0]


# Script texts whose SQL is put together: literals and variables, calls between, adjacent literals, f-strings and plain braces, comments, two calls side by side.
HARD_SCRIPTS = """SELECT concat('ETL.H_', o_orderkey) AS id, o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 8 < 4 THEN 'LUA' ELSE 'PYTHON' END AS script_language, CASE o_orderkey % 8
WHEN 0 THEN concat('query("SELECT a FROM " .. sch .. ".T JOIN CRM.C_', o_custkey, ' ON 1=1 " .. x .. " JOIN STG.O_', o_orderkey, '")')
WHEN 1 THEN concat('q("SELECT 1 FROM A." .. t .. " JOIN CRM.C_', o_custkey, ' ON a=b", "JOIN NO.NE")')
WHEN 2 THEN concat('local a = "SELECT 1 FROM CRM.C_', o_custkey, '" .. f("SELECT 2 FROM STG.O_', o_orderkey, '", k[1]) .. " JOIN Z.W" -- "SELECT 3 FROM COM.MENT"')
WHEN 3 THEN concat('f("SELECT 1 FROM CRM.C_', o_custkey, '")("JOIN NO.NE")\ng({"SELECT 1 FROM", "P.Q"})')
WHEN 4 THEN concat('x = "SELECT * FROM CRM.C_', o_custkey, '" " JOIN STG.O_', o_orderkey, ' ON {z} = 1"  # "JOIN COM.MENT"')
WHEN 5 THEN concat('x = ("SELECT * FROM CRM.C_', o_custkey, '"\n  + name\n  + " JOIN STG.O_', o_orderkey, '")\n"JOIN NOT.ME"')
WHEN 6 THEN concat('x = f"SELECT * FROM {a}.T JOIN CRM.C_', o_custkey, ' ON {{b}}" f" JOIN E_{n}.F, {q}"')
ELSE concat('d = {"q": "SELECT 1 FROM CRM.C_', o_custkey, '", "r": "C.D"}') END AS script_text FROM orders"""


@query(f"""WITH h AS ({HARD_SCRIPTS})
SELECT id, 'CRM' AS ref_schema, concat('C_', c) AS ref_name, CASE WHEN k % 8 IN (0, 1, 6) THEN 'JOIN' ELSE 'SELECT' END AS reference_type FROM h
UNION ALL SELECT id, 'STG', concat('O_', k), CASE WHEN k % 8 = 2 THEN 'SELECT' ELSE 'JOIN' END FROM h WHERE k % 8 IN (0, 2, 4, 5) UNION ALL SELECT id, 'Z', 'W', 'JOIN' FROM h WHERE k % 8 = 2""")
def script_refs_hard(spark, sf_dir):
    return sqltext.script_refs(_sql(spark, sf_dir, HARD_SCRIPTS), ["id"], "script_text", "script_language").select("id", "ref_schema", "ref_name", "reference_type")


# The same words are a comment, a literal or neither by the dialect.
DIALECT_TEXTS = """SELECT p_partkey AS k, replace(replace(concat('SELECT 1 FROM A.B_', p_partkey, ' # FROM X.Y
 JOIN C.D_', p_size, ' ON a = "it~s FROM E.F" AND b = ~x^~ FROM G.H~ // FROM I.J
 JOIN K.L ON c = $$ FROM M.N $$'), '~', chr(39)), '^', chr(92)) AS sql, p_size AS s FROM part"""


@query(f"""WITH t AS ({DIALECT_TEXTS}), d(dialect) AS (VALUES ('bigquery'), ('mysql')), e AS (SELECT k, s, dialect FROM t, d)
SELECT dialect, k, 'A' AS ref_schema, concat('B_', k) AS ref_name, 'SELECT' AS reference_type FROM e UNION ALL SELECT dialect, k, 'C', concat('D_', s), 'JOIN' FROM e
UNION ALL SELECT dialect, k, 'I', 'J', 'SELECT' FROM e UNION ALL SELECT dialect, k, 'K', 'L', 'JOIN' FROM e UNION ALL SELECT dialect, k, 'M', 'N', 'SELECT' FROM e
UNION ALL SELECT 'snowflake', k, 'A', concat('B_', k), 'SELECT' FROM t UNION ALL SELECT 'snowflake', k, 'X', 'Y', 'SELECT' FROM t
UNION ALL SELECT 'snowflake', k, 'C', concat('D_', s), 'JOIN' FROM t UNION ALL SELECT 'snowflake', k, 'K', 'L', 'JOIN' FROM t""")
def sql_refs_dialects(spark, sf_dir):
    texts, out = _sql(spark, sf_dir, DIALECT_TEXTS), None
    for dialect in ("bigquery", "mysql", "snowflake"):
        found = sqltext.table_refs(texts, ["k"], "sql", dialect=dialect).select(F.lit(dialect).alias("dialect"), "k", "ref_schema", "ref_name", "reference_type")
        out = found if out is None else out.unionByName(found)
    return out


# Tables that are called like functions, keywords and variables.
_WORDS = ["USER", "SEQUENCE", "HASH", "WINDOW", "MODE", "STACK", "DATE", "POSITION", "RANK", "V_X"]
NAME_TEXTS = f"""SELECT c_custkey AS k, concat('SELECT 1 FROM A.T_', c_custkey, ' JOIN {" JOIN ".join(f"S.{w}" for w in _WORDS)} JOIN SEQUENCE JOIN DATE JOIN V_', c_custkey, ' JOIN USER JOIN SUM') AS sql FROM customer"""


@query(f"""WITH t AS ({NAME_TEXTS}) SELECT k, 'A' AS ref_schema, concat('T_', k) AS ref_name FROM t UNION ALL SELECT k, NULL, 'SEQUENCE' FROM t
UNION ALL SELECT k, 'S', w FROM t, (VALUES {", ".join(f"('{w}')" for w in _WORDS)}) AS words(w)""")
def sql_refs_names(spark, sf_dir):
    return sqltext.table_refs(_sql(spark, sf_dir, NAME_TEXTS), ["k"], "sql").select("k", "ref_schema", "ref_name")


@query(f"""WITH s AS ({SCRIPTS}), x AS (SELECT id, concat('make("CREATE TABLE NEW.N_', o_orderkey, ' AS SELECT 1 FROM CRM.C_', o_custkey, '") -- "DROP TABLE S.T"') AS t, o_orderkey, o_custkey FROM s), cat AS ({CATALOG})
SELECT id, 'NEW' AS ref_schema, concat('N_', o_orderkey) AS ref_name, 'DDL' AS reference_type, NULL AS object_id FROM x UNION ALL SELECT x.id, 'CRM', concat('C_', o_custkey), 'SELECT', cat.id FROM x JOIN cat ON cat.id = concat('CRM.C_', o_custkey)""")
def script_known_refs(spark, sf_dir):
    scripts = _sql(spark, sf_dir, SCRIPTS).select(
        "id", F.lit("LUA").alias("script_language"), F.concat(F.lit('make("CREATE TABLE NEW.N_'), "o_orderkey", F.lit(" AS SELECT 1 FROM CRM.C_"), "o_custkey", F.lit('") -- "DROP TABLE S.T"')).alias("script_text")
    )
    return build.known_refs(scripts, _sql(spark, sf_dir, CATALOG)).drop("is_target")


CONNECTIONS = "SELECT concat('CON_', s_suppkey) AS CONNECTION_NAME, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS USER_NAME, concat(s_name, s_nationkey) AS CONNECTION_STRING, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS CREATED, s_name AS CONNECTION_COMMENT FROM supplier"


@query(f"""WITH c AS ({CONNECTIONS}) SELECT concat('CONNECTION.', CONNECTION_NAME) AS id, 'CONNECTION' AS schema, CONNECTION_NAME AS name, 'CONNECTION' AS type, coalesce(nullif(USER_NAME, ''), 'SYS') AS owner, 'exasol' AS platform,
CONNECTION_STRING AS connection_string, USER_NAME AS "user", CONNECTION_COMMENT AS description FROM c""")
def catalog_connections(spark, sf_dir):
    return catalog.connections(_sql(spark, sf_dir, CONNECTIONS)).select("id", "schema", "name", "type", "owner", "platform", "connection_string", "user", "description")


SCHEMAS = "SELECT concat('VS_', n_nationkey) AS SCHEMA_NAME, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_name END AS SCHEMA_OWNER, CAST(n_nationkey AS BIGINT) AS SCHEMA_OBJECT_ID, 'A.ADAPTER' AS ADAPTER_SCRIPT, n_name AS ADAPTER_NOTES FROM nation"


@query(f"""WITH v AS ({SCHEMAS}) SELECT concat(SCHEMA_NAME, '.VIRTUAL_SCHEMA') AS id, SCHEMA_NAME AS schema, 'VIRTUAL_SCHEMA' AS type, coalesce(SCHEMA_OWNER, 'SYS') AS owner, SCHEMA_OBJECT_ID AS object_id, ADAPTER_SCRIPT AS adapter_name, ADAPTER_NOTES AS description FROM v""")
def catalog_virtual_schemas(spark, sf_dir):
    return catalog.virtual_schemas(_sql(spark, sf_dir, SCHEMAS)).select("id", "schema", "type", "owner", "object_id", "adapter_name", "description")


CATALOG_VIEWS = "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'TMP' ELSE 'CRM' END AS VIEW_SCHEMA, c_name AS VIEW_NAME, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'OWN' END AS VIEW_OWNER, c_mktsegment AS VIEW_COMMENT, concat('SELECT ', c_custkey) AS VIEW_TEXT, CAST(c_custkey AS BIGINT) AS VIEW_OBJECT_ID FROM customer"


@query(f"""WITH v AS ({CATALOG_VIEWS}), c AS ({COLUMNS}) SELECT concat('CRM.', VIEW_NAME) AS id, coalesce(nullif(VIEW_OWNER, ''), 'SYS') AS owner, VIEW_TEXT AS definition, VIEW_COMMENT AS description,
coalesce((SELECT string_agg(COLUMN_NAME, ',' ORDER BY COLUMN_ORDINAL_POSITION) FROM c WHERE COLUMN_TABLE = VIEW_NAME), '') AS columns FROM v WHERE VIEW_SCHEMA = 'CRM'""")
def catalog_views(spark, sf_dir):
    found = catalog.views(_sql(spark, sf_dir, CATALOG_VIEWS), _sql(spark, sf_dir, COLUMNS), exclude=["TMP"])
    return found.select("id", "owner", "definition", "description", F.array_join("columns.name", ",").alias("columns"))


CATALOG_SCRIPTS = "SELECT 'ETL' AS SCRIPT_SCHEMA, concat('F_', p_partkey) AS SCRIPT_NAME, CASE p_size % 3 WHEN 0 THEN 'LUA' WHEN 1 THEN 'PYTHON' ELSE 'R' END AS SCRIPT_LANGUAGE, 'ME' AS SCRIPT_OWNER, CAST(p_partkey AS BIGINT) AS SCRIPT_OBJECT_ID, p_type AS SCRIPT_COMMENT, 'UDF' AS SCRIPT_TYPE, p_name AS SCRIPT_TEXT, concat('INT,', p_brand) AS SCRIPT_INPUT_TYPE, 'INT' AS SCRIPT_RESULT_TYPE, p_brand FROM part"


@query(f"""WITH s AS ({CATALOG_SCRIPTS}) SELECT concat('ETL.', SCRIPT_NAME) AS id, 'LUA_UDF' AS type, SCRIPT_LANGUAGE AS script_language, SCRIPT_TEXT AS script_text, concat('param_1=INT;param_2=', p_brand) AS params, 'col_1=INT' AS results FROM s WHERE SCRIPT_LANGUAGE <> 'R'""")
def catalog_scripts(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("=", m["name"], m["data_type"])), ";")
    found = catalog.scripts(_sql(spark, sf_dir, CATALOG_SCRIPTS))
    return found.select("id", "type", "script_language", "script_text", shown("input_parameters").alias("params"), shown("output_columns").alias("results"))


WAREHOUSE_VIEWS = "SELECT 'p' AS project_id, 'd' AS dataset_id, c_name AS table_name, c_mktsegment AS view_definition FROM customer"


@query(f"""WITH t AS ({WAREHOUSE_VIEWS}), c AS ({WAREHOUSE_COLUMNS}) SELECT concat('bigquery:p.d.', table_name) AS id, 'BIGQUERY_VIEW' AS type, 'p' AS owner, view_definition AS definition,
(SELECT count(*) FROM c WHERE c.table_name = t.table_name) AS n_columns FROM t""")
def warehouse_views(spark, sf_dir):
    found = catalog.warehouse_views(_sql(spark, sf_dir, WAREHOUSE_VIEWS), _sql(spark, sf_dir, WAREHOUSE_COLUMNS))
    return found.select("id", "type", "owner", "definition", F.size("columns").cast("long").alias("n_columns"))


WAREHOUSE_ROUTINES = "SELECT 'p' AS project_id, 'd' AS dataset_id, c_name AS routine_name, CASE WHEN c_custkey % 2 = 0 THEN 'FUNCTION' ELSE 'PROCEDURE' END AS routine_type, c_mktsegment AS routine_definition, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS last_altered FROM customer"


@query(f"WITH r AS ({WAREHOUSE_ROUTINES}) SELECT concat('bigquery:p.d.', routine_name) AS id, CASE routine_type WHEN 'FUNCTION' THEN 'BIGQUERY_UDF' ELSE 'BIGQUERY_PROCEDURE' END AS type, routine_definition AS definition FROM r")
def warehouse_routines(spark, sf_dir):
    return catalog.warehouse_routines(_sql(spark, sf_dir, WAREHOUSE_ROUTINES)).select("id", "type", "definition")


PROJECTS = "SELECT CASE c_custkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'q' ELSE 'r' END AS project_id, concat('d', c_nationkey) AS dataset_id, c_name AS table_name FROM customer"


@query(f"WITH t AS ({PROJECTS}) SELECT * FROM t WHERE (project_id = 'p' AND dataset_id IN ('d1', 'd2', 'd3')) OR project_id = 'q'")
def project_datasets(spark, sf_dir):
    return catalog.in_datasets(_sql(spark, sf_dir, PROJECTS), {"p": ["d1", "d2", "d3"], "q": None})


FILES = """SELECT concat('/git/repo_', o_orderkey % 5, '/bigquery/f_', o_orderkey, '.sql') AS path, concat('repo_', o_orderkey % 5) AS repo, CASE o_orderkey % 3
WHEN 0 THEN concat('CREATE OR REPLACE VIEW `p.d.v', o_orderkey, '` AS SELECT * FROM d.s', o_custkey, ' JOIN x.y.z ON 1 = 1') WHEN 1 THEN concat('create table if not exists d.t', o_orderkey, ' as select * from d.t', o_orderkey, ', d.u')
ELSE 'SELECT 1 FROM d.nothing' END AS content, o_orderkey AS k, o_custkey AS c FROM orders"""


@query(f"""WITH f AS ({FILES}) SELECT concat('BIGQUERY.D.S', c) AS source_id, concat('BIGQUERY.P.D.V', k) AS target_id, 'DATA' AS dependency_type, 'SELECT' AS reference_type FROM f WHERE k % 3 = 0
UNION ALL SELECT 'BIGQUERY.X.Y.Z', concat('BIGQUERY.P.D.V', k), 'DATA', 'JOIN' FROM f WHERE k % 3 = 0 UNION ALL SELECT 'BIGQUERY.D.U', concat('BIGQUERY.D.T', k), 'DATA', 'SELECT' FROM f WHERE k % 3 = 1""")
def corpus_edges(spark, sf_dir):
    return build.corpus_graph(_sql(spark, sf_dir, FILES))[1]


@query(f"""WITH f AS ({FILES}) SELECT CASE k % 3 WHEN 0 THEN concat('BIGQUERY.P.D.V', k) ELSE concat('BIGQUERY.D.T', k) END AS id, CASE k % 3 WHEN 0 THEN concat('v', k) ELSE concat('t', k) END AS name, CASE k % 3 WHEN 0 THEN 'VIEW' ELSE 'TABLE' END AS type, path AS source_file, content AS sql_text FROM f WHERE k % 3 < 2""")
def corpus_objects(spark, sf_dir):
    return build.corpus_graph(_sql(spark, sf_dir, FILES))[0]


@query(f"""WITH f AS ({FILES}) SELECT count(DISTINCT repo) AS repos_scanned, count(*) AS sql_files_parsed, count(*) FILTER (k % 3 < 2) AS objects_found, sum(CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS dependencies_found FROM f""")
def corpus_counters(spark, sf_dir):
    files = _sql(spark, sf_dir, FILES)
    return build.corpus_counters(files, *build.corpus_graph(files))


@query("SELECT p_partkey, p_name AS content FROM part")
def base64_content(spark, sf_dir):
    coded = _sql(spark, sf_dir, "SELECT p_partkey, concat(substring(base64(p_name), 1, 4), '\n', substring(base64(p_name), 5)) AS content FROM part")
    return coded.select("p_partkey", corpus.decoded("content").alias("content"))


@query(r"SELECT p_partkey, concat(p_brand, chr(10), p_type, chr(9), p_name, chr(13)) AS text FROM part")
def unescape_sql(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT p_partkey, p_brand, p_type, p_name FROM part")
    return rows.select("p_partkey", sqltext.unescaped(F.concat("p_brand", F.lit(r"\n"), "p_type", F.lit(r"\\t"), "p_name", F.lit(r"\r"))).alias("text"))


@query("SELECT p_partkey, printf('%,d', p_partkey * 12345) AS grouped, CASE WHEN p_size > 20 THEN p_size - 20 ELSE 0 END AS more, least(p_size, 20)::BIGINT AS shown FROM part")
def fmt_lists(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT p_partkey, p_size FROM part").withColumn("list", F.sequence(F.lit(1), "p_size"))
    first, more = formats.shown_columns(F.col("list"))
    return rows.select("p_partkey", formats.grouped_number(F.col("p_partkey") * 12345).alias("grouped"), more.alias("more"), F.size(first).cast("long").alias("shown"))


@query("SELECT c_name AS id, 100000 + row_number() OVER (ORDER BY c_name) - 1 AS object_id FROM customer")
def numbered_ids(spark, sf_dir):
    return cache.numbered(_sql(spark, sf_dir, "SELECT c_name AS id FROM customer"), ["id"])


@query(f"""WITH v AS ({VIEWS}), cat AS ({CATALOG}), e AS (SELECT id, concat('CRM.C_', o_custkey) AS c FROM v)
SELECT coalesce((SELECT min(cat.id) FROM cat WHERE upper(cat.id) = e.c), e.c) AS source_object_id, 'NAME' AS source_column, id AS target_object_id, 'CNAME' AS target_column, 'DIRECT' AS transformation_type FROM e""")
def view_column_deps(spark, sf_dir):
    found = build.view_column_dependencies(_sql(spark, sf_dir, VIEWS), _sql(spark, sf_dir, CATALOG)).where("target_column = 'CNAME'")
    return found.drop("transformation")


PANEL = "SELECT concat('C.', c_custkey) AS id, c_name AS own, c_custkey % 3 AS m FROM customer"


@query(f"WITH p AS ({PANEL}) SELECT id, CASE m WHEN 0 THEN 'A,B' ELSE own END AS columns FROM p")
def panel_columns(spark, sf_dir):
    rows = _sql(spark, sf_dir, PANEL)
    objects = rows.select("id", F.array(F.struct(F.col("own").alias("name"))).alias("columns"))
    traced = rows.where("m < 2").select(F.col("id").alias("object_id"), F.when(F.col("m") == 0, F.array(F.lit("A"), F.lit(""), F.lit("B"))).otherwise(F.array(F.lit("UNKNOWN"))).alias("columns"))
    return view.panel_columns(objects, traced).select("id", F.array_join("columns", ",").alias("columns"))


SHOWN = "SELECT concat('C.', c_custkey) AS id, c_custkey % 2 = 0 AS has_more_upstream, c_custkey % 3 = 0 AS has_more_downstream, c_custkey AS k FROM customer"


@query(f"""WITH s AS ({SHOWN}) SELECT id, has_more_upstream AND k % 5 <> 0 AS can_expand_up, k % 5 = 0 AND k <> 5 AS can_collapse_up, has_more_downstream AND k % 7 <> 0 AS can_expand_down, k % 7 = 0 AND k <> 5 AS can_collapse_down FROM s""")
def affordances(spark, sf_dir):
    s = _sql(spark, sf_dir, SHOWN)
    return view.affordances(s.drop("k"), s.where("k % 5 = 0").select("id"), s.where("k % 7 = 0").select("id"), "C.5").select("id", "can_expand_up", "can_collapse_up", "can_expand_down", "can_collapse_down")


@query(f"WITH b AS ({BASE}) SELECT id, object_id FROM b")
def cache_roundtrip(spark, sf_dir):
    objects = _sql(spark, sf_dir, BASE).withColumns({c: F.lit("x") for c in ("schema", "name", "owner")}).withColumn("type", F.lit("TABLE"))
    none = objects.sparkSession.createDataFrame([], COLUMN_DEP)
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    cache.write_tables(cache.CacheTables(conform(objects, OBJECT), conform(_sql(spark, sf_dir, BASE_DEPS), TABLE_DEP), none), path)
    return cache.read_tables(spark, path).objects.select("id", "object_id")


# A whole cache as one JSON document: objects with columns and odd texts, edges with duplicates, column edges.
_CACHED = """SELECT concat('C.', c_custkey) AS id, c_mktsegment AS schema, concat('"', c_name, '} ', chr(10), 'é') AS name, CASE WHEN c_custkey % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END AS type, 'o' AS owner, CAST(c_custkey AS BIGINT) AS object_id, concat(chr(92), c_nationkey, '"') AS description FROM customer"""
_CACHED_DEPS = BASE_DEPS + " UNION ALL SELECT concat('N.', c_nationkey), concat('C.', c_custkey), 'AGAIN', 'SELECT', CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 20 = 0"
_CACHED_COLUMNS = "SELECT 'C.1' AS source_object_id, concat('A', c_custkey % 7) AS source_column, concat('C.', c_custkey) AS target_object_id, '{B' AS target_column, 'x' AS transformation, 'DIRECT' AS transformation_type, CAST(c_custkey AS BIGINT) AS seq FROM customer"


@query(f"""WITH o AS ({_CACHED}), d AS ({_CACHED_DEPS}), c AS ({_CACHED_COLUMNS}), p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM d)
SELECT 'object' AS part, id AS a, name AS b, concat(schema, type, description, CASE WHEN object_id % 2 = 0 THEN 'X}},Y' ELSE '' END) AS c FROM o UNION ALL SELECT 'edge', source_id, target_id, concat(dependency_type, reference_type) FROM d
UNION ALL SELECT 'column', concat(source_object_id, source_column), target_object_id, concat(target_column, transformation, transformation_type) FROM c
UNION ALL SELECT 'by_schema', schema, id, '' FROM o UNION ALL SELECT 'by_type', type, id, '' FROM o UNION ALL SELECT 'forward', s, t, '' FROM p UNION ALL SELECT 'backward', t, s, '' FROM p
UNION ALL SELECT 'counters', (SELECT count(*)::VARCHAR FROM o), (SELECT (2 * count(*))::VARCHAR FROM o WHERE object_id % 2 = 0), (SELECT count(*)::VARCHAR FROM d)""")
def cache_json_roundtrip(spark, sf_dir):
    """A document written by many tasks and read by many: all that it holds."""
    listed = F.from_json(F.lit('[{"name": "X}", "data_type": "INT"}, {"name": "Y"}]'), OBJECT["columns"].dataType)
    objects = conform(_sql(spark, sf_dir, _CACHED).withColumn("columns", F.when(F.col("object_id") % 2 == 0, listed)), OBJECT)
    tables = cache.CacheTables(objects, conform(_sql(spark, sf_dir, _CACHED_DEPS), TABLE_DEP), conform(_sql(spark, sf_dir, _CACHED_COLUMNS), COLUMN_DEP))
    path = f"{new_path(spark, 'cache')}.json"
    cache.write_document(tables, path)
    back, indexes = cache.read_cache(spark, path), cache.read_indexes(spark, path)
    names = F.coalesce(F.array_join("columns.name", ","), F.lit(""))
    out = back.objects.select(F.lit("object").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.concat("schema", "type", "description", names).alias("c"))
    out = out.unionByName(back.table_deps.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.concat("dependency_type", "reference_type").alias("c")))
    out = out.unionByName(back.column_deps.select(F.lit("column").alias("part"), F.concat("source_object_id", "source_column").alias("a"), F.col("target_object_id").alias("b"), F.concat("target_column", "transformation", "transformation_type").alias("c")))
    out = out.unionByName(indexes.select(F.col("index").alias("part"), F.col("key").alias("a"), F.col("id").alias("b"), F.lit("").alias("c")))
    head = spark.read.text(path).where(F.startswith("value", F.lit('{"metadata"'))).select(F.from_json(F.concat("value", F.lit('"x": 1}')), "metadata struct<object_count: string, column_count: string, dependency_count: string>").alias("m"))
    return out.unionByName(head.select(F.lit("counters").alias("part"), F.col("m.metadata.object_count").alias("a"), F.col("m.metadata.column_count").alias("b"), F.col("m.metadata.dependency_count").alias("c")))
