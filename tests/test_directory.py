"""Pages, single objects and substring search from files in id order, against scans."""

import random
import shutil
from pathlib import Path

import pytest

from tracewell.graph import LineageGraph
from tracewell.operators import catalog
from tracewell.operators.directory import Directory

SCHEMA = "id string, schema string, name string, type string"


def make_objects(spark, n=600, seed=1):
    rng = random.Random(seed)
    parts = ["ORD", "er_", "50%", "Größe", "naïve", "x", "🙂a", " ", "customer", "Straße", "_%", "İ"]
    rows = []
    for k in range(n):
        name = "".join(rng.choice(parts) for _ in range(rng.randrange(5))) if k % 11 else None
        rows.append((f"{rng.choice(['s', 'é', 'T'])}.{rng.randrange(10**6):06d}.{k}", rng.choice(["S", "é", "T", None]), name, rng.choice(["TABLE", "VIEW", None])))
    rows.append(("long." + "abcdefghij" * 3 + "k", "S", "abcdefghij" * 40, "TABLE"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def both(spark):
    objects = make_objects(spark).cache()
    return objects, Directory.build(objects, rows_per_part=50)


QUERIES = ["a", "É", "%", "_", " ", "r_", "0%", "ßE", "ord", "🙂a", "größ", "customer", "CUSTOMERx", "er_50%naïve", "abcdefghijabcdefghijabcdefghij", "s.1", "nowhere at all", "zz", "aaaa", "jab", "ghijk"]


@pytest.mark.parametrize("filters", [(None, None), ("é", None), ("S", "VIEW")])
def test_search_equals_the_scan(both, filters):
    objects, index = both
    for q in QUERIES if filters == (None, None) else QUERIES[:9]:
        for limit in (3, 1000):
            want = [r.id for r in catalog.search(objects, q, limit, *filters).collect()]
            assert [r.id for r in index.search(q, limit, *filters).collect()] == want, q


def test_pages_equal_the_scan(both):
    objects, index = both
    for schema, type_ in ((None, None), ("T", None), (None, "VIEW"), ("é", "TABLE"), ("none", None)):
        assert index.total(schema, type_) == catalog.filtered(objects, schema, type_).count()
        for number, size in ((1, 10), (2, 49), (3, 50), (5, 7), (4, 200), (99, 50)):
            want = [r.id for r in catalog.page(objects, number, size, schema, type_).collect()]
            assert [r.id for r in index.page(number, size, schema, type_).collect()] == want


def test_only_what_is_needed_is_read(spark, both, tmp_path):
    objects, index = both
    path = Path(index.path.removeprefix("file://"))
    shutil.copytree(path, tmp_path / "all")
    copy = Directory.open(spark, f"file://{tmp_path}/all")
    q = "größ"
    grams = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    buckets = {r[0] for r in copy.spark.createDataFrame([(g,) for g in grams], "gram string").selectExpr(f"pmod(xxhash64(gram), {copy.buckets})").collect()}
    want = [r.id for r in catalog.search(objects, q, 2).collect()]
    hits = {r.part for r in copy.objects.where(f"lower(id) LIKE '%{q}%' OR lower(name) LIKE '%{q}%'").select("part").distinct().collect()}
    for folder in (tmp_path / "all/postings").glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in buckets:
            shutil.rmtree(folder)
    for folder in (tmp_path / "all/objects").glob("part=*"):
        if int(folder.name.split("=")[1]) not in hits:
            shutil.rmtree(folder)
    assert len(list((tmp_path / "all/postings").glob("bucket=*"))) <= len(buckets)
    assert [r.id for r in Directory.open(spark, f"file://{tmp_path}/all").search(q, 2).collect()] == want
    # a late page reads the parts it lies in
    plan = index.page(12, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and plan.count("Exchange") <= 1


def test_graph_with_a_directory(spark, both):
    objects, index = both
    deps = spark.createDataFrame([], "source_id string, target_id string, dependency_type string, reference_type string, seq long")
    g = LineageGraph(objects, deps, spark.createDataFrame([], "source_object_id string, source_column string, target_object_id string, target_column string, transformation string, transformation_type string, seq long"), index)
    plain = LineageGraph(objects, deps, g.column_deps)
    some = plain.search("ord", 5).collect()[-1].id
    assert g.object(some).collect() == plain.object(some).collect()
    for missing in ("", "zzzz", some + "x"):
        with pytest.raises(KeyError):
            g.object(missing)
    assert g.objects(3, 20, "S")["items"].collect() == plain.objects(3, 20, "S")["items"].collect() and g.objects(1, 20, "S")["total"] == plain.objects(1, 20, "S")["total"]
    assert g.search("ORD", 7).collect() == plain.search("ORD", 7).collect()


def test_empty_catalog(spark):
    index = Directory.build(spark.createDataFrame([], SCHEMA))
    assert index.total() == 0 and index.page(1, 10).count() == 0 and index.get("x").count() == 0 and index.search("abc").count() == 0 and index.search("a").count() == 0


def test_postings_of_a_part():
    """Made in one sort of numbers: every gram of every text once, its places in order (F23, F24)."""
    import pyarrow as pa

    from tracewell.operators import directory

    rows = [(4, "🙂a🙂a", "", "x"), (1, "aaa", "é", ""), (2, "", "", "")]
    part = pa.table({"part": pa.array([7] * 3, pa.int32()), "place": pa.array([r[0] for r in rows], pa.int32()), **{c: [r[k] for r in rows] for k, c in enumerate(directory.TEXTS, 1)}})
    want = {}
    for place, *texts in sorted(rows):
        for g in {t[k : k + n] for t in texts for n in (1, 2, 3) for k in range(len(t) - n + 1)}:
            want.setdefault(g, []).append(place)
    got = directory._postings(part).to_pylist()
    assert {r["gram"]: r["places"] for r in got} == want and len(got) == len(want)
    assert all(r["part"] == 7 and r["n"] == len(r["places"]) for r in got)
    assert directory._postings(part.slice(2)).num_rows == 0
