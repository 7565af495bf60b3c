"""A graph that grows by runs: what each version holds, who writes, who reads, and which files are touched."""

from pathlib import Path

import pytest

from tracewell.operators.traverse import FORWARD, levels, snapshot, traverse
from tracewell.operators.versions import GraphStore
from tracewell.storage import new_path

EDGE = "source_id string, target_id string, dependency_type string, reference_type string, seq long"


def edges_of(spark, *rows):
    return spark.createDataFrame([(a, b, k, "SELECT", n) for n, (a, b, k) in enumerate(rows)], EDGE)


def ids_of(spark, text):
    return spark.createDataFrame([(c,) for c in text], "id string")


def held(version):
    rows = [(r.source_id, r.target_id, r.dependency_type) for r in version.edges.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return set(rows)


def walked(version, seed, depth=5):
    seeds = version.spark.createDataFrame([(seed, seed)], "seed string, id string")
    return {(r.id, r.level) for r in levels(version.snapshot, seeds, depth, FORWARD).where("known").collect()}


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path.removeprefix("file://")).rglob("*") if p.is_file()}


@pytest.fixture
def store(spark):
    base = edges_of(spark, ("a", "b", "OLD"), ("a", "b", "BASE"), ("b", "c", "BASE"), ("c", "d", "BASE"))
    return GraphStore.create(spark, new_path(spark, "graph"), ids_of(spark, "abcd"), base, buckets=3)


def test_versions(spark, store):
    first, before = store.latest(), files(store.path)
    store.append(ids_of(spark, "e"), edges_of(spark, ("b", "c", "NEW"), ("d", "e", "NEW")))
    store.append(ids_of(spark, "f"), edges_of(spark, ("b", "c", "GUESS"), ("e", "f", "GUESS")), wins="first")
    store.append(ids_of(spark, ""), edges_of(spark, ("e", "f", "SURE"), ("b", "c", "LAST")))
    assert {p: s for p, s in files(store.path).items() if p in before} == before  # nothing written earlier is touched
    assert held(first) == held(store.at(0)) == {("a", "b", "BASE"), ("b", "c", "BASE"), ("c", "d", "BASE")}
    assert held(store.at(2)) == {("a", "b", "BASE"), ("b", "c", "NEW"), ("c", "d", "BASE"), ("d", "e", "NEW"), ("e", "f", "GUESS")}
    last = {("a", "b", "BASE"), ("b", "c", "LAST"), ("c", "d", "BASE"), ("d", "e", "NEW"), ("e", "f", "SURE")}
    assert held(store.latest()) == last and store.latest().number == 3
    assert walked(first, "a") == {(c, k) for k, c in enumerate("abcd")} and walked(store.latest(), "a") == {(c, k) for k, c in enumerate("abcdef")}
    compacted = GraphStore(spark, store.path).compact()
    assert compacted.number == 4 and len(compacted.runs) == 1 and held(compacted) == last and walked(compacted, "b", 2) == {("b", 0), ("c", 1), ("d", 2)}
    store.collect_garbage(keep=1)
    assert store.versions() == [4] and held(store.latest()) == last and len(list(Path(store.path.removeprefix("file://"), "runs").iterdir())) == 1
    seeds = spark.createDataFrame([("b", "b")], "seed string, id string")
    whole = traverse(compacted.snapshot, seeds, 2, FORWARD)
    plain = traverse(snapshot(compacted.ids, compacted.edges.selectExpr("*", "0L AS seq")), seeds, 2, FORWARD)
    assert set(whole.nodes.collect()) == set(plain.nodes.collect()) and set(whole.edges.collect()) == set(plain.edges.collect())


def test_two_writers(spark, store, monkeypatch):
    """Another writer is quicker: the run is kept and gets the next number; a compaction keeps what came meanwhile."""
    other, commit = GraphStore(spark, store.path), GraphStore._commit

    def late(self, number, buckets, runs):
        if self is store and late.armed:
            late.armed = False
            other.append(ids_of(spark, "x"), edges_of(spark, ("a", "x", "OTHER")))
        return commit(self, number, buckets, runs)

    monkeypatch.setattr(GraphStore, "_commit", late)
    late.armed = True
    assert store.append(ids_of(spark, "y"), edges_of(spark, ("a", "y", "MINE"))).number == 2
    late.armed = True
    compacted = store.compact()
    assert compacted.number == 4 and len(compacted.runs) == 2
    assert held(compacted) == {("a", "b", "BASE"), ("b", "c", "BASE"), ("c", "d", "BASE"), ("a", "x", "OTHER"), ("a", "y", "MINE")}
    again = GraphStore.create(spark, store.path, ids_of(spark, "q"), edges_of(spark))
    assert again.latest().number == 4  # what is there holds
    with pytest.raises(ValueError):
        store.append(ids_of(spark, "q"), edges_of(spark), wins="none")


def test_tables_that_change(spark, tmp_path):
    """The registered queries' graph follows the files of the folder, and is made again where the shared folder was cleaned."""
    import shutil

    from tracewell.plans import derive

    for t in derive.TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    n = derive.store(spark, str(tmp_path)).latest().edges.count()
    assert derive.store(spark, str(tmp_path)).versions() == [0]
    path = derive.store(spark, str(tmp_path)).path
    shutil.rmtree(path.removeprefix("file://"))
    assert derive.store(spark, str(tmp_path)).latest().edges.count() == n
    small = spark.read.parquet(f"{tmp_path}/customer.parquet").limit(5).toPandas()
    (tmp_path / "customer.parquet").unlink()
    small.to_parquet(tmp_path / "customer.parquet")
    assert derive.store(spark, str(tmp_path)).path != path and derive.store(spark, str(tmp_path)).latest().edges.count() < n


def test_the_first_run_is_not_sorted_to_settle_later_ones(spark, store):
    """Nulls in a pair and a later run that gives way too (F19)."""
    store.append(ids_of(spark, ""), edges_of(spark, ("b", "c", "NEW"), (None, "c", "NEW")))
    store.append(ids_of(spark, ""), edges_of(spark, ("a", "b", "GUESS"), (None, "c", "GUESS"), ("c", "a", "GUESS")), wins="first")
    plan = store.latest().edges._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert held(store.latest()) == held(store.compact()) == {("a", "b", "BASE"), ("b", "c", "NEW"), ("c", "d", "BASE"), (None, "c", "NEW"), ("c", "a", "GUESS")}


def test_sql_edges_are_stored_once(spark):
    """A call reads the edges several times; each is a plain read (F22)."""
    from tracewell import sql
    from tracewell.graph import LineageGraph

    cols = "source_object_id string, source_column string, target_object_id string, target_column string, transformation string, transformation_type string, seq long"
    objects = spark.createDataFrame([("a", "S", "a", "TABLE")], "id string, schema string, name string, type string")
    sql.register(spark, LineageGraph(objects, edges_of(spark, ("a", "b", "OLD"), ("a", "b", "NEW")), spark.createDataFrame([], cols)), "once_")
    view = spark.table("once_edges")
    assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
    assert [r.dependency_type for r in view.collect()] == ["NEW"]
