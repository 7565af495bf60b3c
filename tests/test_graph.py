"""Golden mini-graphs and a property test against a plain breadth-first search."""

import random

import pytest

from tracewell.operators.traverse import last_wins
from tracewell.graph import LineageGraph
from tracewell.operators import traverse, view
from tracewell.operators.traverse import BACKWARD, FORWARD

DEPS = "source_id string, target_id string, dependency_type string, reference_type string, seq long"
COLS = "source_object_id string, source_column string, target_object_id string, target_column string, transformation string, transformation_type string, seq long"


@pytest.fixture(scope="module")
def graph(spark):
    objects = spark.createDataFrame([(i, "S", i, "TABLE") for i in "ABCDE"], "id string, schema string, name string, type string")
    pairs = [("A", "B", "ETL"), ("A", "C", "ETL"), ("B", "D", "VIEW"), ("C", "D", "VIEW"), ("D", "A", "ETL"), ("D", "X", "ETL"), ("A", "B", "VIEW"), ("E", "E", "ETL")]
    deps = spark.createDataFrame([(s, t, k, "SELECT", n) for n, (s, t, k) in enumerate(pairs)], DEPS)
    edges = [("T1", "a", "V1", "x", None, "DIRECT"), ("T1", "b", "V1", "x", "b + 1", "EXPRESSION"), ("V1", "x", "V2", "y", "SUM(x)", "AGGREGATE"), ("T1", "a", "V2", "y", "COALESCE(a,0)", "FUNCTION"), ("V2", "y", "V3", "z", None, "CAST"), ("p:q.r.s", "c", "V9", "k", None, "DIRECT")]
    cols = spark.createDataFrame([(*e, n) for n, e in enumerate(edges)], COLS)
    return LineageGraph(objects, deps, cols)


def nodes(found):
    return {(r.id, r.level, r.has_more_upstream, r.has_more_downstream) for r in found.nodes.collect()}


def edges(found):
    return {f"{r.source_id}{r.target_id}" for r in found.edges.collect()}


def test_forward(graph):
    one = graph.forward_lineage("A", 1)
    assert nodes(one) == {("A", 0, True, True), ("B", 1, False, True), ("C", 1, False, True)}
    assert {(r.source_id + r.target_id, r.dependency_type) for r in one.edges.collect()} == {("AB", "VIEW"), ("AC", "ETL")}
    three = graph.forward_lineage("A", 3)
    assert {n[0] for n in nodes(three)} == set("ABCD")
    assert edges(three) == {"AB", "AC", "BD", "CD", "DA", "DX"}


def test_backward_and_full(graph):
    assert nodes(graph.backward_lineage("D", 2)) == {("D", 0, True, True), ("B", 1, True, False), ("C", 1, True, False), ("A", 2, False, False)}
    assert nodes(graph.forward_lineage("E", 1)) == {("E", 0, False, False)}
    full = graph.full_lineage("A", 1, 1)
    assert {(n[0], n[2], n[3]) for n in nodes(full)} == {("A", True, True), ("B", False, True), ("C", False, True), ("D", True, True)}
    assert edges(full) == {"DA", "AB", "AC"}
    zero = graph.full_lineage("A", 0, 0)
    assert {n[0] for n in nodes(zero)} == {"A"} and not edges(zero)


def test_bounds(graph):
    with pytest.raises(KeyError):
        graph.forward_lineage("UNKNOWN")
    with pytest.raises(ValueError):
        graph.forward_lineage("A", 6)
    with pytest.raises(ValueError):
        graph.search("")
    assert graph.statistics().first().total_dependencies == 8
    assert graph.objects(2, 4)["total_pages"] == 2 and graph.objects(9, 4)["items"].count() == 0


def test_columns(graph):
    def rows(*args, **kw):
        return {(r.level, f"{r.object_id}.{r.column}", f"{r.via_object_id}.{r.via_column}") for r in traverse.column_lineage(graph.walked_columns, *args, **kw).collect()}

    def seed(spark, o, c):
        return spark.createDataFrame([(o, o, c)], "seed string, object_id string, column string")

    spark = graph.column_deps.sparkSession
    assert rows(seed(spark, "V2", "y"), "upstream", 3) == {(1, "T1.a", "V2.y"), (1, "V1.x", "V2.y"), (2, "T1.b", "V1.x")}
    assert rows(seed(spark, "T1", "a"), "downstream", 3) == {(1, "V1.x", "T1.a"), (1, "V2.y", "T1.a"), (2, "V3.z", "V2.y")}
    assert rows(seed(spark, "V9", "k"), "both", 3) == {(1, "p:q.r.s.c", "V9.k")}
    assert not rows(seed(spark, "none", "k"), "both", 2)
    assert {r.object_id: r.columns for r in graph.columns_with_lineage().collect()}["T1"] == ["a", "b"]


def test_view_operators(graph):
    spark = graph.table_deps.sparkSession
    shown = view.load(graph.walked, "A")
    bigger = view.expand(shown, graph.walked, "B", FORWARD)
    assert {r.source_id + r.target_id for r in bigger.edges.collect()} == {"DA", "AB", "AC", "BD"}
    smaller = view.collapse(shown, "A", BACKWARD)
    assert {r.id for r in smaller.nodes.collect()} == {"A", "B", "C"}
    offered = view.affordances(shown.nodes, spark.createDataFrame([("D",)], "id string"), spark.createDataFrame([("A",)], "id string"), "A")
    row = {r.id: r for r in offered.collect()}
    assert row["D"].can_collapse_up and not row["A"].can_collapse_down and row["B"].can_expand_down


@pytest.mark.parametrize("trial", range(3))
def test_against_plain_search(spark, trial):
    rng = random.Random(trial)
    ids = [f"n{k}" for k in range(12)]
    known = set(rng.sample(ids, 10))
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(22)]
    objects = spark.createDataFrame([(i,) for i in sorted(known)], "id string")
    deps = spark.createDataFrame([(s, t, "ETL", "SELECT", n) for n, (s, t) in enumerate(pairs)], DEPS)
    seeds = sorted(known)[:2]
    found = traverse.traverse(traverse.snapshot(objects, deps), spark.createDataFrame([(s, s) for s in seeds], "seed string, id string"), 2)
    got = {(r.seed, r.id, r.level) for r in found.nodes.collect()}
    want = set()
    for s in seeds:
        level, front = {s: 0}, [s]
        for d in (1, 2):
            front = [t for a in front if a in known for x, t in pairs if x == a and t not in level and not level.__setitem__(t, d)]
        want |= {(s, i, d) for i, d in level.items() if i in known}
    assert got == want


def test_edges_are_dealt_before_they_are_sorted(spark):
    rows = [("A", "B", "ETL", "SELECT", 1), ("A", "B", "VIEW", "JOIN", 2), ("A", "C", "ETL", "SELECT", 0)]
    found = last_wins(spark.createDataFrame(rows, "source_id string, target_id string, dependency_type string, reference_type string, seq long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("Exchange")[1]
    assert {(r.source_id, r.target_id, r.dependency_type, r.reference_type) for r in found.collect()} == {("A", "B", "VIEW", "JOIN"), ("A", "C", "ETL", "SELECT")}


def test_column_edges_are_settled_in_one_shuffle(spark, monkeypatch):
    """What settles the pairs also orders the files; the parts grow with the rows (F20)."""
    rows = [("A", "x", "B", "y", "old", "DIRECT", 1), ("A", "x", "B", "y", None, "CAST", 2), ("A", "x", "B", "y", "new", "CAST", 2), ("A", "X", "B", "y", None, "DIRECT", 0)]
    deps = spark.createDataFrame(rows, COLS)
    held = traverse.dealt_last(deps, traverse.COLUMN_KEYS, traverse.COLUMN_REST, 3)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    assert {(r.source_column, r.transformation, r.transformation_type) for r in held.collect()} == {("x", "new", "CAST"), ("X", None, "DIRECT")}
    monkeypatch.setattr(traverse, "ROWS_PER_SORT", 1)
    assert "rangepartitioning" in traverse.dealt_last(deps, traverse.COLUMN_KEYS, traverse.COLUMN_REST, 3, 37)._jdf.queryExecution().executedPlan().toString().split(", 37)")[0]
