"""The questions of a graph as SQL table functions, for plain SQL and LATERAL joins.

``register`` makes temporary views of a graph and functions over them whose
bodies are SQL, so Catalyst plans a call together with the query around it and a
call under LATERAL is one job for all rows. Walks are unrolled to ``MOST_STEPS``
levels, each without repeats; walks without limit are ``operators.closure``.

    register(spark, graph)
    spark.sql("SELECT s.name, l.id, l.level FROM picked s, LATERAL lineage(s.id, 3) l")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewell.graph import LineageGraph
from tracewell.operators.traverse import EDGE_KEYS, EDGE_REST, dealt_last
from tracewell.storage import park

MOST_STEPS = 5
_WAYS = {"lineage": ("source_id", "target_id"), "lineage_up": ("target_id", "source_id")}


def _walk(near: str, far: str, prefix: str) -> str:
    """A SELECT of id and level: the known ids that root reaches through known ids, in the fewest steps, up to depth.

    Each level ends with the join that drops unknown ids, so it is dealt by id, which is what the next level and the
    search for repeats need: a pair of root and id crosses the network once a level. Level 0, which may be dealt
    otherwise, stays apart, and the levels name what they reached anew, without which Spark takes their union for dealt
    at random.
    """
    level, found = f"SELECT id FROM {prefix}objects WHERE id = root", []
    start = f"SELECT DISTINCT id, 0 AS level FROM ({level})"
    for k in range(1, MOST_STEPS + 1):
        before = level if k < 3 else f"SELECT DISTINCT id FROM ({level})"  # the first level has no repeats, as a pair has one edge
        level = f"SELECT o.id FROM ({before}) b JOIN {prefix}edges e ON e.{near} = b.id JOIN {prefix}objects o ON o.id = e.{far} WHERE depth >= {k} AND o.id <> root"
        found.append(f"SELECT id AS reached, {k} AS level FROM ({level})")
    return f"{start} UNION ALL SELECT reached, min(level) FROM ({' UNION ALL '.join(found)}) GROUP BY reached"


def bodies(prefix: str) -> dict[str, tuple[str, str, str]]:
    """Name of each function, with its parameters, columns and query."""
    both = {name: ("root STRING, depth INT", "id STRING, level INT", _walk(near, far, prefix)) for name, (near, far) in _WAYS.items()}
    near = f"SELECT target_id AS id, 'downstream' AS direction, dependency_type, reference_type FROM {prefix}edges WHERE source_id = root"
    near += f" UNION ALL SELECT source_id, 'upstream', dependency_type, reference_type FROM {prefix}edges WHERE target_id = root"
    columns = f"SELECT 'upstream' AS direction, target_column AS `column`, source_object_id AS object_id, source_column AS other_column, transformation_type FROM {prefix}columns WHERE target_object_id = root"
    columns += f" UNION ALL SELECT 'downstream', source_column, target_object_id, target_column, transformation_type FROM {prefix}columns WHERE source_object_id = root"
    search = f"SELECT id, schema, name, type FROM {prefix}objects WHERE contains(lower(name), lower(query)) OR contains(lower(schema), lower(query)) OR contains(lower(id), lower(query))"
    return both | {
        "neighbours": ("root STRING", "id STRING, direction STRING, dependency_type STRING, reference_type STRING", near),
        "column_neighbours": ("root STRING", "direction STRING, `column` STRING, object_id STRING, other_column STRING, transformation_type STRING", columns),
        "search_objects": ("query STRING", "id STRING, schema STRING, name STRING, type STRING", search),
    }


def register(spark: SparkSession, graph: LineageGraph, prefix: str = "tracewell_") -> list[str]:
    """Views {prefix}objects, {prefix}edges (one for each pair) and {prefix}columns, and the functions; gives the functions' names.

    The edges are reduced and stored here, as a call reads them several times; they lie sorted by target, which keeps what
    is read and sent of them small.

    lineage(root, depth) and lineage_up(root, depth): id, level of known objects, up to MOST_STEPS; neighbours(root);
    column_neighbours(root); search_objects(query).
    """
    graph.objects_.createOrReplaceTempView(f"{prefix}objects")
    last = dealt_last(graph.table_deps, EDGE_KEYS[::-1], EDGE_REST, 1, graph.table_deps.count())
    park(last.select(*EDGE_KEYS, *EDGE_REST), "sql-edges").createOrReplaceTempView(f"{prefix}edges")
    graph.column_deps.createOrReplaceTempView(f"{prefix}columns")
    for name, (parameters, columns, body) in bodies(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(bodies(prefix))
