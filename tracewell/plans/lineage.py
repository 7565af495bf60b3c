"""Queries over the derived graph, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import formats
from tracewell.graph import LineageGraph
from tracewell import sql
from tracewell.operators import bitmaps, catalog, closure, directory, traverse, view
from tracewell.operators.traverse import BACKWARD, FORWARD
from tracewell.operators.versions import GraphStore
from tracewell.plans import derive
from tracewell.sources import cache, corpus
from tracewell.storage import new_path, park

QUERIES, ORACLES = {}, {}
ROOT, LEAF, ORDER, CUSTOMER = "R.0", "P.7", "O.7", "C.7"
GRAPH = f"""
objs AS MATERIALIZED ({derive.OBJECTS_SQL}),
deps AS MATERIALIZED ({derive.EDGES_SQL}),
edges AS MATERIALIZED (SELECT source_id, target_id, arg_max(struct_pack(dependency_type, reference_type), struct_pack(seq, dependency_type, reference_type)) AS e FROM deps GROUP BY ALL),
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed string, id string")


def _bfs_sql(seeds: list[str], depth: int, near: str, far: str, name: str = "reached") -> str:
    start = " UNION ALL ".join(f"SELECT '{s}' AS seed, '{s}' AS id, 0 AS level" for s in seeds)
    return f"""{name}_ AS ({start} UNION SELECT r.seed, e.{far}, r.level + 1 FROM {name}_ r JOIN objs o ON o.id = r.id JOIN edges e ON e.{near} = r.id WHERE r.level < {depth}),
{name} AS (SELECT seed, id, min(level) AS level FROM {name}_ GROUP BY ALL)"""


FORWARD_SQL = f"WITH RECURSIVE {GRAPH} {_bfs_sql([ROOT], 3, 'source_id', 'target_id')} SELECT seed, r.id, level FROM reached r JOIN objs USING (id)"


def _forward(spark: SparkSession, sf_dir: str, depth: int = 3):
    return traverse.traverse(derive.graph(spark, sf_dir), _seeds(spark, ROOT), depth, FORWARD)


@query(FORWARD_SQL)
def lineage_forward(spark, sf_dir):
    return _forward(spark, sf_dir).nodes.select("seed", "id", "level")


@query(f"WITH RECURSIVE {GRAPH} {_bfs_sql([LEAF, 'P.8', ORDER], 4, 'target_id', 'source_id')} SELECT seed, r.id, level FROM reached r JOIN objs USING (id)")
def lineage_backward(spark, sf_dir):
    found = traverse.traverse(derive.graph(spark, sf_dir), _seeds(spark, LEAF, "P.8", ORDER), 4, BACKWARD)
    return found.nodes.select("seed", "id", "level")


def _flags_sql(run: str) -> str:
    """seed, id, level and both flags of the nodes of one run."""
    more = "SELECT 1 FROM edges e LEFT JOIN {run} r ON r.seed = n.seed AND r.id = e.{far} WHERE e.{near} = n.id AND (r.level IS NULL OR r.level > n.level)"
    up, down = more.format(run=run, near="target_id", far="source_id"), more.format(run=run, near="source_id", far="target_id")
    return f"(SELECT n.seed, n.id, n.level, EXISTS ({up}) AS has_more_upstream, EXISTS ({down}) AS has_more_downstream FROM {run} n JOIN objs USING (id))"


_FULL = f"{_bfs_sql([CUSTOMER], 2, 'target_id', 'source_id', 'up')}, {_bfs_sql([CUSTOMER], 2, 'source_id', 'target_id', 'down')}"


@query(f"""WITH RECURSIVE {GRAPH} {_FULL}, u AS {_flags_sql("up")}, d AS {_flags_sql("down")}
SELECT coalesce(d.seed, u.seed) AS seed, coalesce(d.id, u.id) AS id, least(coalesce(d.level, u.level), coalesce(u.level, d.level)) AS level,
       coalesce(d.has_more_upstream, u.has_more_upstream) AS has_more_upstream, coalesce(d.has_more_downstream, u.has_more_downstream) AS has_more_downstream FROM d FULL JOIN u ON d.id = u.id""")
def lineage_full(spark, sf_dir):
    return traverse.full(derive.graph(spark, sf_dir), _seeds(spark, CUSTOMER), 2, 2).nodes


@query(f"""WITH RECURSIVE {GRAPH} {_FULL} SELECT '{CUSTOMER}' AS seed, source_id, target_id, e.dependency_type, e.reference_type FROM edges
WHERE target_id IN (SELECT id FROM up JOIN objs USING (id) WHERE level < 2) OR source_id IN (SELECT id FROM down JOIN objs USING (id) WHERE level < 2)""")
def lineage_full_edges(spark, sf_dir):
    return traverse.full(derive.graph(spark, sf_dir), _seeds(spark, CUSTOMER), 2, 2).edges


@query(f"""WITH RECURSIVE {GRAPH} {_bfs_sql([ROOT], 3, 'source_id', 'target_id')}
SELECT seed, source_id, target_id, e.dependency_type, e.reference_type FROM reached r JOIN objs o ON o.id = r.id JOIN edges ON source_id = r.id WHERE level < 3""")
def lineage_edges(spark, sf_dir):
    return _forward(spark, sf_dir).edges


@query(f"""WITH RECURSIVE {GRAPH} {_bfs_sql([ROOT], 2, 'source_id', 'target_id')},
n AS (SELECT r.seed, r.id, r.level FROM reached r JOIN objs USING (id)),
beside AS (SELECT n.seed, n.id, n.level, e.source_id AS other, true AS up FROM n JOIN edges e ON e.target_id = n.id
           UNION ALL SELECT n.seed, n.id, n.level, e.target_id, false FROM n JOIN edges e ON e.source_id = n.id),
more AS (SELECT b.seed, b.id, up FROM beside b LEFT JOIN reached r ON r.seed = b.seed AND r.id = b.other WHERE r.level IS NULL OR r.level > b.level)
SELECT n.*, EXISTS (SELECT 1 FROM more m WHERE m.seed = n.seed AND m.id = n.id AND up) AS has_more_upstream,
       EXISTS (SELECT 1 FROM more m WHERE m.seed = n.seed AND m.id = n.id AND NOT up) AS has_more_downstream FROM n""")
def lineage_has_more(spark, sf_dir):
    return _forward(spark, sf_dir, 2).nodes


# A day's changes: edges that replace others, new ones, and ones that give way to what is there.
_CHANGED = """SELECT concat('C.', o_custkey) AS source_id, concat('O.', o_orderkey) AS target_id, 'RELOAD' AS dependency_type, 'SELECT' AS reference_type, CAST(0 AS BIGINT) AS seq FROM orders WHERE o_orderkey % 100 = 0
UNION ALL SELECT concat('O.', o_orderkey), 'X.1', 'ETL', 'SELECT', 0 FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT concat('O.', o_orderkey), 'X.1', 'LATER', 'SELECT', 1 FROM orders WHERE o_orderkey % 200 = 0"""
_GIVING_WAY = """SELECT concat('N.', c_nationkey) AS source_id, concat('C.', c_custkey) AS target_id, 'GUESS' AS dependency_type, 'SELECT' AS reference_type, CAST(0 AS BIGINT) AS seq FROM customer
UNION ALL SELECT 'X.1', concat('C.', c_custkey), 'GUESS', 'SELECT', 0 FROM customer WHERE c_custkey % 50 = 0"""
_VERSIONS = f"""WITH RECURSIVE {GRAPH} c AS ({_CHANGED}), g AS ({_GIVING_WAY}),
c1 AS (SELECT source_id, target_id, arg_max(dependency_type, seq) AS k FROM c GROUP BY ALL),
v0 AS (SELECT source_id, target_id, e.dependency_type AS k FROM edges),
v1 AS (SELECT * FROM c1 UNION ALL SELECT * FROM v0 WHERE (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM c1)),
v2 AS (SELECT * FROM v1 UNION ALL SELECT source_id, target_id, dependency_type FROM g WHERE (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM v1))"""


def _grown(spark, sf_dir):
    """A graph of its own with two deltas, and what a reader of version 0 has had open meanwhile."""
    store = GraphStore.create(spark, new_path(spark, "graph"), derive.objects(spark, sf_dir), derive.repeated_edges(spark, sf_dir))
    pinned = store.latest()
    x = spark.createDataFrame([("X.1",)], "id string")
    store.append(x, derive._sql(spark, sf_dir, _CHANGED))
    store.append(x.limit(0), derive._sql(spark, sf_dir, _GIVING_WAY), wins="first")
    return store, pinned


@query(_VERSIONS + """ SELECT version, k, count(*)::BIGINT AS n, min(source_id || target_id) AS low, max(source_id || target_id) AS high
FROM (SELECT 0 AS version, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v2) GROUP BY ALL""")
def graph_append(spark, sf_dir):
    """The edges of each version, the compacted one included."""
    store, pinned = _grown(spark, sf_dir)
    store.compact()
    out = pinned.edges.withColumn("version", F.lit(0))
    for number in (1, 2, 3):
        out = out.unionByName(store.at(number).edges.withColumn("version", F.lit(number)))
    pair = F.concat("source_id", "target_id")
    # the least and greatest string alone would be found by sorting all rows; beside a set of the one kind the few groups stay in a hash table
    few = out.groupBy("version", "dependency_type").agg(F.array_max(F.collect_set("dependency_type")).alias("k"), F.count(F.lit(1)).alias("n"), F.min(pair).alias("low"), F.max(pair).alias("high"))
    return few.select("version", "k", "n", "low", "high")


def _walk_sql(version: str, known: str) -> str:
    return f"""w{version} AS (SELECT 'O.100' AS id, 0 AS level UNION SELECT e.target_id, w.level + 1 FROM w{version} w JOIN ({known}) o ON o.id = w.id JOIN v{version} e ON e.source_id = w.id WHERE w.level < 3)"""


@query(_VERSIONS + f""", {_walk_sql("0", "SELECT id FROM objs")}, {_walk_sql("2", "SELECT id FROM objs UNION SELECT 'X.1'")}
SELECT 0 AS version, id, min(level) AS level FROM w0 JOIN objs USING (id) GROUP BY id UNION ALL SELECT 2, id, min(level) FROM w2 JOIN (SELECT id FROM objs UNION SELECT 'X.1') USING (id) GROUP BY id""")
def lineage_versions(spark, sf_dir):
    """A walk on the runs of the latest version, and one by the reader that had opened the first."""
    store, pinned = _grown(spark, sf_dir)
    seeds = _seeds(spark, "O.100")
    nodes = lambda v: traverse.traverse(v.snapshot, seeds, 3, FORWARD).nodes.select(F.lit(v.number).alias("version"), "id", "level")
    return nodes(pinned).unionByName(nodes(store.latest()))


@query(f"WITH {GRAPH[:-2]} SELECT (SELECT count(*) FROM objs)::BIGINT AS objects, (SELECT count(*) FROM edges)::BIGINT AS edges, (SELECT count(DISTINCT source_id) FROM edges)::BIGINT AS sources")
def graph_build(spark, sf_dir):
    """What walks need before the first: the reduced edges in buckets of either end."""
    built = GraphStore.create(spark, new_path(spark, "graph"), derive.objects(spark, sf_dir), derive.repeated_edges(spark, sf_dir)).latest()
    n = built.edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"))
    return built.ids.agg(F.count(F.lit(1)).alias("objects")).join(n)  # one row each


CYCLE = f"objs AS (SELECT DISTINCT event_type AS id FROM events), edges AS MATERIALIZED ({derive.TRANSITIONS_SQL}),"


@query(f"""WITH RECURSIVE {CYCLE} {_bfs_sql(['click', 'purchase'], 3, 'source_id', 'target_id')}
SELECT seed, source_id, target_id, level FROM reached JOIN objs USING (id) JOIN edges ON source_id = id WHERE level < 3""")
def lineage_cycle(spark, sf_dir):
    objects, edges = derive.transitions(spark, sf_dir)
    found = traverse.traverse(traverse.snapshot(objects, edges), _seeds(spark, "click", "purchase"), 3, FORWARD)
    return found.edges.join(found.nodes.withColumnRenamed("id", "source_id"), ["seed", "source_id"]).select("seed", "source_id", "target_id", "level")


@query(f"""WITH RECURSIVE {GRAPH} {_bfs_sql([CUSTOMER], 2, 'source_id', 'target_id')}
SELECT seed, target_id, count(*)::BIGINT AS n FROM reached JOIN objs USING (id) JOIN edges ON source_id = id WHERE level < 2 AND target_id NOT IN (SELECT id FROM objs) GROUP BY ALL""")
def lineage_dangling(spark, sf_dir):
    objects = derive.objects(spark, sf_dir)
    found = traverse.traverse(derive.graph(spark, sf_dir), _seeds(spark, CUSTOMER), 2, FORWARD)
    return found.edges.join(objects.select(F.col("id").alias("target_id")), "target_id", "left_anti").groupBy("seed", "target_id").agg(F.count(F.lit(1)).alias("n"))


def _registered(spark, sf_dir):
    sql.register(spark, LineageGraph(derive.objects(spark, sf_dir), derive.repeated_edges(spark, sf_dir), derive.column_edges(spark, sf_dir)))
    return spark


@query(f"WITH RECURSIVE {GRAPH} {_bfs_sql([ROOT], 3, 'source_id', 'target_id')} SELECT r.id, level FROM reached r JOIN objs USING (id)")
def sql_lineage(spark, sf_dir):
    return _registered(spark, sf_dir).sql(f"SELECT * FROM lineage('{ROOT}', 3)")


@query(f"""WITH RECURSIVE {GRAPH} start AS (SELECT id FROM objs WHERE schema = 'CAT'),
r AS (SELECT id AS seed, id, 0 AS level FROM start UNION SELECT r.seed, e.source_id, r.level + 1 FROM r JOIN objs o ON o.id = r.id JOIN edges e ON e.target_id = r.id WHERE r.level < 2),
up AS (SELECT seed, id, min(level) AS level FROM r JOIN objs USING (id) GROUP BY ALL),
near AS (SELECT s.id AS seed, count(*) AS n FROM start s JOIN edges e ON e.source_id = s.id OR e.target_id = s.id GROUP BY s.id)
SELECT seed, level, count(*)::BIGINT AS found, max(near.n)::BIGINT AS neighbours FROM up LEFT JOIN near USING (seed) GROUP BY seed, level""")
def sql_lateral(spark, sf_dir):
    """Two table functions under LATERAL for every part."""
    return _registered(spark, sf_dir).sql("""WITH start AS (SELECT id FROM tracewell_objects WHERE schema = 'CAT'), near AS (SELECT s.id, count(*) AS n FROM start s, LATERAL neighbours(s.id) GROUP BY s.id)
        SELECT s.id AS seed, u.level, count(*) AS found, max(near.n) AS neighbours FROM start s JOIN LATERAL lineage_up(s.id, 2) u LEFT JOIN near ON near.id = s.id GROUP BY s.id, u.level""")


def _reach_sql(near: str, far: str, *seeds: str) -> str:
    start = " UNION ALL ".join(f"SELECT '{s}' AS seed, '{s}' AS id" for s in seeds)
    return f"r AS ({start} UNION SELECT r.seed, e.{far} FROM r JOIN objs o ON o.id = r.id JOIN edges e ON e.{near} = r.id) SELECT seed, id FROM r"


@query(f"WITH RECURSIVE {GRAPH} {_reach_sql('source_id', 'target_id', 'N.3', 'C.7', 'C.8', 'S.1', 'none')}")
def closure_forward(spark, sf_dir):
    return closure.closure(derive.graph(spark, sf_dir), _seeds(spark, "N.3", "C.7", "C.8", "S.1", "none"), FORWARD)


@query(f"WITH RECURSIVE {CYCLE} {_reach_sql('target_id', 'source_id', 'click', 'purchase')}")
def closure_cycle(spark, sf_dir):
    objects, edges = derive.transitions(spark, sf_dir)
    return closure.closure(traverse.snapshot(objects, edges), _seeds(spark, "click", "purchase"), BACKWARD)


@query("""SELECT concat('E.', arg_min(event_id, struct_pack(ts, event_id))) AS seed, count(*)::BIGINT AS n, min(concat('E.', event_id)) AS first_id, max(concat('E.', event_id)) AS last_id FROM events GROUP BY user_id""")
def closure_chains(spark, sf_dir):
    objects, edges, seeds = derive.chains(spark, sf_dir)
    reached = closure.closure(traverse.snapshot(objects, edges), seeds, FORWARD)
    return reached.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _column_sql(object_id: str, column: str, depth: int, direction: str) -> str:
    near, far = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = [f"cols AS MATERIALIZED ({derive.COLUMN_EDGES_SQL})",
             """ce AS MATERIALIZED (SELECT source_object_id, source_column, target_object_id, target_column, arg_max(struct_pack(t := transformation, k := transformation_type), struct_pack(seq, t := transformation, k := transformation_type)) AS e
             FROM cols GROUP BY source_object_id, source_column, target_object_id, target_column)""",
             f"s0 AS (SELECT '{object_id}' AS o, '{column}' AS c)"]
    for level in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT o, c FROM s{k}" for k in range(level))
        steps.append(f"""s{level} AS MATERIALIZED (SELECT {far}_object_id AS o, {far}_column AS c, min(struct_pack(o := {near}_object_id, c := {near}_column)) AS via, arg_min(ce.e, struct_pack(o := {near}_object_id, c := {near}_column)) AS e
            FROM s{level - 1} JOIN ce ON {near}_object_id = o AND {near}_column = c WHERE ({far}_object_id, {far}_column) NOT IN ({before}) GROUP BY 1, 2)""")
    rows = " UNION ALL ".join(
        f"SELECT '{object_id}' AS seed, '{direction}' AS direction, {k} AS level, o AS object_id, c AS column, via.o AS via_object_id, via.c AS via_column, e.t AS transformation, e.k AS transformation_type FROM s{k}"
        for k in range(1, depth + 1)
    )
    return f"WITH {', '.join(steps)} {rows}"


def _column_seed(spark, object_id: str, column: str) -> DataFrame:
    return spark.createDataFrame([(object_id, object_id, column)], "seed string, object_id string, column string")


@query(_column_sql(LEAF, "PRICE", 3, "upstream"))
def column_upstream(spark, sf_dir):
    return traverse.column_lineage(derive.column_graph(spark, sf_dir), _column_seed(spark, LEAF, "PRICE"), "upstream", 3)


@query(_column_sql("N.3", "KEY", 3, "downstream"))
def column_downstream(spark, sf_dir):
    return traverse.column_lineage(derive.column_graph(spark, sf_dir), _column_seed(spark, "N.3", "KEY"), "downstream", 3)


@query(f"SELECT * FROM ({_column_sql('C.7', 'NAME', 3, 'upstream')}) UNION ALL SELECT * FROM ({_column_sql('C.7', 'NAME', 3, 'downstream')}) UNION ALL SELECT * FROM ({_column_sql('C.1', 'BALANCE', 3, 'upstream')}) UNION ALL SELECT * FROM ({_column_sql('C.1', 'BALANCE', 3, 'downstream')})")
def column_both(spark, sf_dir):
    seeds = _column_seed(spark, "C.7", "NAME").unionByName(_column_seed(spark, "C.1", "BALANCE"))
    return traverse.column_lineage(derive.column_graph(spark, sf_dir), seeds, "both", 3)


@query(f"""WITH cols AS ({derive.COLUMN_EDGES_SQL}),
r AS (SELECT target_column AS "column", 'upstream' AS direction, source_object_id AS object_id, source_column AS other_column, transformation, transformation_type, seq FROM cols WHERE target_object_id = '{ORDER}'
      UNION ALL SELECT source_column, 'downstream', target_object_id, target_column, transformation, transformation_type, seq FROM cols WHERE source_object_id = '{ORDER}')
SELECT "column", direction, object_id, other_column, e.t AS transformation, e.k AS transformation_type FROM (SELECT "column", direction, object_id, other_column, arg_max(struct_pack(t := transformation, k := transformation_type), seq) AS e
FROM r GROUP BY "column", direction, object_id, other_column)""")
def object_columns(spark, sf_dir):
    return traverse.object_columns(derive.column_edges(spark, sf_dir), ORDER)


@query(f"SELECT source_object_id, source_column, target_object_id, target_column, transformation_type FROM ({derive.COLUMN_EDGES_SQL}) WHERE source_object_id = '{CUSTOMER}' OR target_object_id = '{CUSTOMER}'")
def touching_columns(spark, sf_dir):
    found = traverse.touching_columns(derive.column_edges(spark, sf_dir), CUSTOMER)
    return found.select("source_object_id", "source_column", "target_object_id", "target_column", "transformation_type")


@query(f"""WITH cols AS ({derive.COLUMN_EDGES_SQL})
SELECT object_id, string_agg(c, ',' ORDER BY c) AS columns FROM (SELECT DISTINCT source_object_id AS object_id, source_column AS c FROM cols UNION SELECT target_object_id, target_column FROM cols) GROUP BY object_id""")
def columns_with_lineage(spark, sf_dir):
    return traverse.columns_with_lineage(derive.column_edges(spark, sf_dir)).select("object_id", F.array_join("columns", ",").alias("columns"))


@query(f"SELECT id, schema, name, type FROM ({derive.OBJECTS_SQL}) WHERE contains(lower(name), 'r_1') OR contains(lower(schema), 'r_1') OR contains(lower(id), 'r_1') ORDER BY id LIMIT 100")
def search(spark, sf_dir):
    return catalog.search(derive.objects(spark, sf_dir), "R_1", 100).select("id", "schema", "name", "type")


@query(f"SELECT id, schema, name, type FROM ({derive.OBJECTS_SQL}) WHERE schema = 'ORD' AND type = 'VIEW' ORDER BY id LIMIT 50 OFFSET 100")
def objects_page(spark, sf_dir):
    return catalog.page(derive.objects(spark, sf_dir), 3, 50, "ORD", "VIEW").select("id", "schema", "name", "type")


# The objects with accents, searched by texts of one to thirty characters, wildcards and accents among them.
_ACCENTS = "SELECT id, schema, replace(replace(name, 'E', 'É'), 'omer', 'ömer%') AS name, type FROM"
SEARCHES = ["7", "é", "r_", "%", "_1", "er%", "s.1", "R_1", "tömer%#0000", "STömer%#00000000000000001", "customer#000000000000000000001", "order_12", "vié", "nowhere"]


@query(f"""WITH o AS ({_ACCENTS} ({derive.OBJECTS_SQL})), q(q) AS (VALUES {", ".join(f"('{q}')" for q in SEARCHES)}),
hits AS (SELECT q, id, schema, name, type, row_number() OVER (PARTITION BY q ORDER BY id) AS k FROM o, q WHERE contains(lower(name), lower(q)) OR contains(lower(schema), lower(q)) OR contains(lower(id), lower(q)))
SELECT q, id, schema, name, type FROM hits WHERE k <= 30 UNION ALL SELECT 'ORD VIEW', id, schema, name, type FROM (SELECT * FROM o WHERE contains(lower(id), '77') AND schema = 'ORD' AND type = 'VIEW' ORDER BY id LIMIT 100)""")
def search_indexed(spark, sf_dir):
    accents = derive.objects(spark, sf_dir).selectExpr("id", "schema", "replace(replace(name, 'E', 'É'), 'omer', 'ömer%') AS name", "type")
    index = directory.Directory.build(accents, rows_per_part=20_000)
    columns = ["id", "schema", "name", "type"]
    out = index.search("77", 100, "ORD", "VIEW").select(F.lit("ORD VIEW").alias("q"), *columns)
    for q in SEARCHES:
        out = out.unionByName(index.search(q, 30).select(F.lit(q).alias("q"), *columns))
    return out


PAGES = [(1, 50, None, None), (3, 50, "ORD", "VIEW"), (120, 100, None, None), (100, 200, None, None), (2, 7, None, "TABLE"), (40, 20, "CAT", None), (9999, 200, None, None)]


@query(f"WITH o AS ({derive.OBJECTS_SQL}) " + " UNION ALL ".join(
    f"SELECT {k} AS asked, id, schema, type FROM (SELECT * FROM o WHERE {f'schema = {chr(39)}{s}{chr(39)}' if s else 'true'} AND {f'type = {chr(39)}{t}{chr(39)}' if t else 'true'} ORDER BY id LIMIT {n} OFFSET {(p - 1) * n})"
    for k, (p, n, s, t) in enumerate(PAGES)) + f" UNION ALL SELECT 99, id, schema, type FROM o WHERE id = '{CUSTOMER}'")
def pages_indexed(spark, sf_dir):
    index = directory.Directory.build(derive.objects(spark, sf_dir), rows_per_part=5_000)
    out = index.get(CUSTOMER).select(F.lit(99).alias("asked"), "id", "schema", "type")
    for k, (p, n, s, t) in enumerate(PAGES):
        out = out.unionByName(index.page(p, n, s, t).select(F.lit(k).alias("asked"), "id", "schema", "type"))
    return out


def _indexed(spark, sf_dir):
    """The objects numbered in the order of ids, and the bitmaps of their schemas and types."""
    numbered = park(cache.numbered(derive.objects(spark, sf_dir).select("id", "schema", "type"), ["id"], 1).withColumnRenamed("object_id", "no"), "numbered")
    return numbered, park(bitmaps.bitmap_index(numbered, ["schema", "type"]), "bitmaps")


@query(f"WITH o AS ({derive.OBJECTS_SQL}) SELECT schema, type, count(*)::BIGINT AS n FROM o GROUP BY ALL UNION ALL SELECT schema, NULL, count(*) FROM o GROUP BY schema UNION ALL SELECT NULL, type, count(*) FROM o GROUP BY type")
def bitmap_counts(spark, sf_dir):
    _, index = _indexed(spark, sf_dir)
    single = bitmaps.value_counts(index)
    one = lambda c: F.when(F.col("column") == c, F.col("value")).alias(c)
    return bitmaps.cross_counts(index, "schema", "type").unionByName(single.select(one("schema"), one("type"), "n"))


@query(f"SELECT id, schema, type FROM ({derive.OBJECTS_SQL}) WHERE schema IN ('GEO', 'SUP', 'BUILDING') AND type = 'TABLE'")
def bitmap_filter(spark, sf_dir):
    numbered, index = _indexed(spark, sf_dir)
    return bitmaps.marked(numbered, bitmaps.selected(index, {"schema": ["GEO", "SUP", "BUILDING"], "type": ["TABLE"]})).select("id", "schema", "type")


# The edge export as a file: its lines, the titles first, without quotes.
@query(f"""WITH {GRAPH[:-2]}, x AS (SELECT concat_ws(',', s.schema, s.name, s.type, t.schema, t.name, t.type, e.dependency_type) AS line FROM edges JOIN objs s ON s.id = source_id JOIN objs t ON t.id = target_id)
SELECT line, count(*)::BIGINT AS n FROM x GROUP BY line UNION ALL SELECT 'Source Schema,Source Name,Source Type,Target Schema,Target Name,Target Type,Dependency Type', 1""")
def edge_export_csv(spark, sf_dir):
    path = new_path(spark, "export")
    export = view.edge_export(traverse.last_wins(derive.edges(spark, sf_dir)), derive.objects(spark, sf_dir))
    corpus.write_edge_csv(export, path)
    lines = spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return lines.select("line", F.when(F.startswith("line", F.lit("Source Schema,")), 1).otherwise(F.col("n")).cast("long").alias("n"))  # each file has the titles


@query(f"WITH o AS ({derive.OBJECTS_SQL}), p AS (SELECT schema, count(*) AS total FROM o GROUP BY schema) SELECT schema, total::BIGINT AS total, ((total + 29) // 30)::BIGINT AS pages FROM p UNION ALL SELECT NULL, count(*), (count(*) + 29) // 30 FROM o")
def page_totals(spark, sf_dir):
    """How many objects and pages each filter gives, from a graph with a directory."""
    objects = derive.objects(spark, sf_dir)
    graph = LineageGraph(objects, derive.edges(spark, sf_dir), derive.column_edges(spark, sf_dir), directory.Directory.build(objects, rows_per_part=5_000))
    names = [None, *(r.schema for r in graph.schemas().collect())]  # a row a schema
    pages = [(name, graph.objects(1, 30, name)) for name in names]
    return spark.createDataFrame([(name, p["total"], p["total_pages"]) for name, p in pages], "schema string, total long, pages long")


@query(f"SELECT DISTINCT schema FROM ({derive.OBJECTS_SQL})")
def schemas(spark, sf_dir):
    return catalog.distinct_sorted(derive.objects(spark, sf_dir), "schema")


@query(f"SELECT DISTINCT type FROM ({derive.OBJECTS_SQL})")
def types(spark, sf_dir):
    return catalog.distinct_sorted(derive.objects(spark, sf_dir), "type")


@query(f"""WITH objs AS ({derive.OBJECTS_SQL}), deps AS ({derive.EDGES_SQL}), cols AS ({derive.COLUMN_EDGES_SQL})
SELECT count(DISTINCT id) AS total_objects, count(DISTINCT schema) AS total_schemas, count(*) FILTER (type = 'TABLE') AS total_tables, count(*) FILTER (type = 'VIEW') AS total_views,
       count(*) FILTER (type = 'LUA_UDF') AS total_udfs, count(*) FILTER (type = 'VIRTUAL_SCHEMA') AS total_virtual_schemas, count(*) FILTER (type = 'CONNECTION') AS total_connections,
       (SELECT count(*) FROM deps) AS total_dependencies, (SELECT count(*) FROM cols) AS total_column_dependencies,
       (SELECT count(DISTINCT o) FROM (SELECT source_object_id AS o FROM cols UNION ALL SELECT target_object_id FROM cols)) AS objects_with_column_lineage FROM objs""")
def statistics(spark, sf_dir):
    return catalog.statistics(derive.objects(spark, sf_dir), derive.edges(spark, sf_dir), derive.column_edges(spark, sf_dir))


@query(f"SELECT type, count(*)::BIGINT AS n, min(id) AS first_id, max(id) AS last_id FROM ({derive.OBJECTS_SQL}) GROUP BY type")
def type_index(spark, sf_dir):
    ids = catalog.inverted_index(derive.objects(spark, sf_dir), "type")
    return ids.groupBy("type").agg(F.count("id").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"SELECT DISTINCT schema, id FROM ({derive.OBJECTS_SQL})")
def schema_index(spark, sf_dir):
    return catalog.inverted_index(derive.objects(spark, sf_dir), "schema")


@query(f"""WITH cols AS ({derive.COLUMN_EDGES_SQL}), ends AS (SELECT source_object_id AS o, source_column AS c FROM cols UNION SELECT target_object_id, target_column FROM cols),
w AS (SELECT concat('C.', c_custkey) AS object_id, CASE c_custkey % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'NAME' ELSE 'none' END AS "column" FROM customer)
SELECT object_id, "column", (SELECT min(c) FROM ends WHERE o = object_id AND upper(c) = upper("column")) AS found FROM w""")
def column_lookup(spark, sf_dir):
    wanted = derive._sql(spark, sf_dir, "SELECT concat('C.', c_custkey) AS object_id, CASE c_custkey % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'NAME' ELSE 'none' END AS column FROM customer")
    return traverse.resolve_columns(wanted, derive.column_edges(spark, sf_dir))


@query(f"SELECT id, schema, name, type, row_count FROM ({derive.OBJECTS_SQL}) WHERE id = '{CUSTOMER}'")
def object_by_id(spark, sf_dir):
    graph = LineageGraph(derive.objects(spark, sf_dir), derive.edges(spark, sf_dir), derive.column_edges(spark, sf_dir))
    return graph.object(CUSTOMER)


@query(f"SELECT id, schema, name FROM ({derive.OBJECTS_SQL}) WHERE schema IN ('GEO', 'SUP', 'CAT') AND schema NOT IN ('SUP')")
def include_exclude(spark, sf_dir):
    return derive.objects(spark, sf_dir).where(catalog.included("schema", ["GEO", "SUP", "CAT"], ["SUP"])).select("id", "schema", "name")


@query(f"SELECT source_id AS id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS neighbours FROM ({derive.EDGES_SQL}) GROUP BY source_id")
def adjacency(spark, sf_dir):
    return catalog.adjacency(derive.edges(spark, sf_dir)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {GRAPH[:-2]} SELECT source_id, target_id, e.dependency_type, e.reference_type FROM edges")
def last_wins(spark, sf_dir):
    return traverse.last_wins(derive.edges(spark, sf_dir))


_VIEW = f"""up AS (SELECT DISTINCT source_id AS id FROM edges WHERE target_id = '{CUSTOMER}'), down AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id = '{CUSTOMER}'),
start AS (SELECT id FROM (SELECT '{CUSTOMER}' AS id UNION SELECT id FROM up UNION SELECT id FROM down) JOIN objs USING (id))"""


@query(f"""WITH {GRAPH} {_VIEW}, near AS (SELECT min(id) AS id FROM up), below AS (SELECT target_id AS id FROM edges WHERE source_id = (SELECT id FROM near))
SELECT id, CASE WHEN id = '{CUSTOMER}' THEN 0 WHEN id IN (SELECT id FROM start) THEN 1 ELSE 2 END AS level FROM (SELECT id FROM start UNION SELECT id FROM below) JOIN objs USING (id)""")
def expand(spark, sf_dir):
    graph = derive.graph(spark, sf_dir)
    shown = view.load(graph, CUSTOMER)
    above = shown.edges.where(F.col("target_id") == CUSTOMER).agg(F.min("source_id")).first()[0]
    return view.expand(shown, graph, above, FORWARD).nodes.select("id", "level")


@query(f"""WITH {GRAPH} {_VIEW}, near AS (SELECT min(id) AS id FROM up)
SELECT source_id, target_id, e.dependency_type, e.reference_type FROM edges WHERE source_id = '{CUSTOMER}' OR target_id = '{CUSTOMER}' OR source_id = (SELECT id FROM near)""")
def expand_edges(spark, sf_dir):
    graph = derive.graph(spark, sf_dir)
    shown = view.load(graph, CUSTOMER)
    above = shown.edges.where(F.col("target_id") == CUSTOMER).agg(F.min("source_id")).first()[0]
    return view.expand(shown, graph, above, FORWARD).edges


@query(f"WITH {GRAPH} {_VIEW} SELECT id, CASE WHEN id = '{CUSTOMER}' THEN 0 ELSE 1 END AS level FROM start WHERE id NOT IN (SELECT id FROM down)")
def collapse(spark, sf_dir):
    return view.collapse(view.load(derive.graph(spark, sf_dir), CUSTOMER), CUSTOMER, FORWARD).nodes.select("id", "level")


@query(f"WITH {GRAPH} {_VIEW} SELECT source_id, target_id, e.dependency_type, e.reference_type FROM edges WHERE target_id = '{CUSTOMER}'")
def collapse_edges(spark, sf_dir):
    return view.collapse(view.load(derive.graph(spark, sf_dir), CUSTOMER), CUSTOMER, FORWARD).edges


@query(f"WITH {GRAPH[:-2]} SELECT source_id, target_id FROM edges WHERE source_id = '{CUSTOMER}' OR target_id = '{CUSTOMER}'")
def highlight(spark, sf_dir):
    edges = traverse.last_wins(derive.edges(spark, sf_dir))
    return view.highlight(edges, CUSTOMER).where("is_highlighted").select("source_id", "target_id")


@query(f"""WITH {GRAPH[:-2]} SELECT s.schema AS "Source Schema", s.name AS "Source Name", s.type AS "Source Type", t.schema AS "Target Schema", t.name AS "Target Name", t.type AS "Target Type", e.dependency_type AS "Dependency Type"
FROM edges JOIN objs s ON s.id = source_id JOIN objs t ON t.id = target_id""")
def edge_export(spark, sf_dir):
    return view.edge_export(traverse.last_wins(derive.edges(spark, sf_dir)), derive.objects(spark, sf_dir))


@query(f"""WITH o AS (SELECT id, type, row_count AS n FROM ({derive.OBJECTS_SQL}) WHERE row_count IS NOT NULL)
SELECT id, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS short_number,
       CASE WHEN n >= 1000000000 THEN printf('%.2f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.2f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.2f KB', n / 1e3) ELSE n::VARCHAR || ' B' END AS short_bytes,
       CASE type WHEN 'LUA_UDF' THEN 'LUA UDF' ELSE type END AS label FROM o""")
def fmt_numbers(spark, sf_dir):
    o = derive.objects(spark, sf_dir).where("row_count IS NOT NULL")
    return o.select("id", formats.human_number(F.col("row_count")).alias("short_number"), formats.human_bytes(F.col("row_count")).alias("short_bytes"), formats.type_label(F.col("type")).alias("label"))
