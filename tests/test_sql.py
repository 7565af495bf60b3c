"""The SQL functions on tables too large to broadcast: rows against a plain search, and how often pairs are dealt."""

import random
import re

import pytest

from tracewell import sql
from tracewell.graph import LineageGraph

COLUMNS = "source_object_id string, source_column string, target_object_id string, target_column string, transformation string, transformation_type string, seq long"
EDGE = "source_id string, target_id string, dependency_type string, reference_type string, seq long"


@pytest.fixture(scope="module")
def pairs(spark):
    """Registers a graph with loops, cycles, repeated edges and ids without an object, and gives its edges."""
    dice = random.Random(5)
    rows = [(f"k{dice.randrange(24)}", f"k{dice.randrange(24)}") for _ in range(45)] + [("k1", "k1"), ("k2", "k3"), ("k3", "k2"), (None, "k1"), ("k1", None)]
    objects = spark.createDataFrame([(f"k{n}", "S", f"k{n}", "TABLE") for n in range(20)], "id string, schema string, name string, type string")
    edges = spark.createDataFrame([(a, b, "ETL", "SELECT", n) for n, (a, b) in enumerate(rows + rows[:9])], EDGE)
    sql.register(spark, LineageGraph(objects, edges, spark.createDataFrame([], COLUMNS)), "large_")
    spark.createDataFrame([(f"k{n}", d) for n in range(24) for d in range(6)], "id string, depth int").createOrReplaceTempView("large_asked")
    return set(rows)


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


def plain(pairs, root, depth):
    known = {f"k{n}" for n in range(20)}
    levels, frontier = {root: 0} if root in known else {}, {root} & known
    for level in range(1, depth + 1):
        frontier = {b for a, b in pairs if a in frontier and b in known} - set(levels)
        levels |= dict.fromkeys(frontier, level)
    return {(root, depth, i, level) for i, level in levels.items()}


@pytest.mark.parametrize("name", ["lineage", "lineage_up"])
def test_walks_equal_a_plain_search(spark, pairs, no_broadcast, name):
    """A depth of each row's own, and a fixed one (F1)."""
    ways = pairs if name == "lineage" else {(b, a) for a, b in pairs}
    want = set().union(*(plain(ways, f"k{n}", d) for n in range(24) for d in range(6)))
    got = [tuple(r) for r in spark.sql(f"SELECT s.id, s.depth, l.id, l.level FROM large_asked s, LATERAL {name}(s.id, s.depth) l").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in spark.sql(f"SELECT s.id, s.depth, l.id, l.level FROM large_asked s, LATERAL {name}(s.id, 2) l WHERE s.depth = 2").collect()]
    assert len(got) == len(set(got)) and set(got) == {r for r in want if r[1] == 2}


def test_a_pair_is_dealt_once_a_level(spark, pairs, no_broadcast):
    """What a level reached is dealt by id; repeats are found there, not by a shuffle of all levels by root and id (F1)."""
    plan = spark.sql("SELECT s.id, l.level FROM large_objects s, LATERAL lineage_up(s.id, 2) l")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)", plan)
    assert keys and not [k for k in keys if "depth#" in k or "root#" in k and "id#" in k]


def test_edges_lie_by_target(spark, pairs):
    """One edge a pair, the last, in files sorted by target and source (F1)."""
    stored = spark.table("large_edges")
    rows = [(r.target_id, r.source_id) for r in stored.collect()]
    assert len(rows) == len(set(rows)) and {(b, a) for a, b in pairs} == set(rows)
    for file in stored.inputFiles():
        at = [(r.target_id or "", r.source_id or "") for r in spark.read.parquet(file).collect()]
        assert at == sorted(at)
