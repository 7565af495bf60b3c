"""Bitmap indexes and the SQL table functions against plain filters and walks."""

import random
from collections import Counter

import pytest

from tracewell import sql
from tracewell.graph import LineageGraph
from tracewell.operators import bitmaps
from tracewell.operators.traverse import FORWARD, levels, snapshot


@pytest.fixture(scope="module")
def numbered(spark):
    rng = random.Random(2)
    rows = [(1 + k * 37, rng.choice(["S", "T", None]), rng.choice(["TABLE", "VIEW"])) for k in range(3000)]  # spread over four blocks
    return rows, spark.createDataFrame(rows, "no long, schema string, type string")


def test_counts_and_selections(numbered):
    rows, df = numbered
    index = bitmaps.bitmap_index(df, ["schema", "type"]).cache()
    assert {r.block for r in index.select("block").distinct().collect()} == {1, 2, 3, 4}
    want = Counter(("schema", s) for _, s, _ in rows) + Counter(("type", t) for *_, t in rows)
    assert {(r.column, r.value): r.n for r in bitmaps.value_counts(index).collect()} == want
    assert {(r.schema, r.type): r.n for r in bitmaps.cross_counts(index, "schema", "type").collect()} == Counter((s, t) for _, s, t in rows)
    for wanted in ({"schema": ["S"], "type": ["VIEW"]}, {"schema": [None, "T"]}, {"schema": ["none"], "type": ["VIEW"]}, {"schema": [None], "type": ["TABLE", "VIEW"]}):
        picked = sorted(n for n, s, t in rows if s in wanted.get("schema", [s]) and t in wanted.get("type", [t]))
        assert bitmaps.count_selected(index, wanted).first().n == len(picked)
        assert sorted(r.no for r in bitmaps.marked(df, bitmaps.selected(index, wanted)).collect()) == picked


def test_indexes_merge(spark, numbered):
    rows, df = numbered
    parts = [bitmaps.bitmap_index(df.where(f"no % 3 = {k}"), ["schema", "type"]) for k in range(3)]
    whole = {(r.column, r.value, r.block): bytes(r.bits) for r in bitmaps.bitmap_index(df, ["schema", "type"]).collect()}
    assert {(r.column, r.value, r.block): bytes(r.bits) for r in bitmaps.merged(parts).collect()} == whole
    assert bitmaps.bitmap_index(df.limit(0), ["type"]).count() == 0


def test_sql_functions(spark):
    rng = random.Random(4)
    pairs = {(f"x{rng.randrange(30)}", f"x{rng.randrange(30)}") for _ in range(60)}
    known = [f"x{k}" for k in range(30) if k % 7]
    objects = spark.createDataFrame([(i, "S", f"Name_{i}", "TABLE") for i in known], "id string, schema string, name string, type string")
    deps = spark.createDataFrame([(a, b, "ETL", "SELECT", n) for n, (a, b) in enumerate(sorted(pairs))], "source_id string, target_id string, dependency_type string, reference_type string, seq long")
    cols = spark.createDataFrame([("x1", "A", "x2", "B", None, "DIRECT", 0)], "source_object_id string, source_column string, target_object_id string, target_column string, transformation string, transformation_type string, seq long")
    names = sql.register(spark, LineageGraph(objects, deps, cols), "t_")
    assert {"lineage", "lineage_up", "neighbours", "column_neighbours", "search_objects"} == set(names)
    seeds = objects.select(objects.id.alias("seed"), "id")
    for depth in (0, 1, 3, 5):
        want = {(r.seed, r.id, r.level) for r in levels(snapshot(objects, deps), seeds, depth, FORWARD).where("known").collect()}
        got = {tuple(r) for r in spark.sql(f"SELECT o.id, l.id, l.level FROM t_objects o, LATERAL lineage(o.id, {depth}) l").collect()}
        assert got == want
    back = {tuple(r) for r in spark.sql("SELECT o.id, l.id FROM t_objects o, LATERAL lineage_up(o.id, 1) l WHERE l.level = 1").collect()}
    assert back == {(b, a) for a, b in pairs if a != b and {a, b} <= set(known)}
    assert spark.sql("SELECT * FROM lineage('nowhere', 3)").count() == 0
    assert [r.id for r in spark.sql("SELECT id FROM search_objects('NAME_X1') ORDER BY id").collect()] == sorted(i for i in known if "name_x1" in f"name_{i}")
    assert [tuple(r) for r in spark.sql("SELECT * FROM column_neighbours('x2')").collect()] == [("upstream", "B", "x1", "A", "DIRECT")]
