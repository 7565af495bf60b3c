"""A large JSON document read in blocks of any size, against Python's own reader."""

import json
import random

import pytest

from tracewell.sources import cache
from tracewell.sources.jsonscan import Scanner, _Pieces, scan

ODD = ["a}b", '"', "\\", "{[", "}}", "né🙂", ",:", "\n", "x" * 60, '\\"}', "]"]


def document(rng, objects_as="map", deps_as="levels", n=24):
    def text():
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))

    def thing(k):
        return {"id": f"S.{k}", "schema": "S", "name": text() or "n", "type": "TABLE", "owner": "o", "object_id": k, "description": text(), "columns": [{"name": text() or "c", "type": "INT", "nullable": True}] * rng.randrange(3)}

    things = [thing(k) for k in range(n)]
    edges = [{"source_id": f"S.{rng.randrange(n)}", "target_id": f"S.{rng.randrange(n)}", "dependency_type": text() or "ETL", "reference_type": "SELECT"} for _ in range(n)]
    columns = [{"source_object_id": "S.1", "source_column": text() or "c", "target_object_id": f"S.{k}", "target_column": "d", "transformation": text(), "transformation_type": "DIRECT"} for k in range(n // 2)]
    deps = {"levels": {"table_level": edges, "column_level": columns, "more": {"table_level": [{"no": 1}]}}, "list": edges, "map": {f"{text()}{k}": e for k, e in enumerate(edges)}}[deps_as]
    objects = {t["id"]: {x: y for x, y in t.items() if x != "id"} for t in things} if objects_as == "map" else things
    parts = [("metadata", {"a": [1, {"objects": {"x": {}}}], "text": "}" * 50}), ("objects", objects), ("dependencies", deps), ("other", {"objects": [{"id": "no"}]})]
    rng.shuffle(parts)
    return dict(parts), things, edges, columns if deps_as == "levels" else []


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("block,objects_as,deps_as,style", [(700, "map", "levels", None), (900, "list", "list", 2), (400, "map", "map", None), (10**8, "list", "levels", 1)])
def test_cache_in_blocks(spark, tmp_path, small_blocks, block, objects_as, deps_as, style):
    doc, things, edges, columns = document(random.Random(block), objects_as, deps_as)
    path = tmp_path / "cache.json"
    path.write_text(json.dumps(doc, indent=style, ensure_ascii=block % 2 == 0) + ("\n \n" if style == 2 else ""))
    small_blocks(block)
    assert block > 10**6 or spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
    found = cache.read_cache(spark, str(path))
    assert {(r.id, r.name, r.description, len(r.columns or [])) for r in found.objects.collect()} == {(t["id"], t["name"], t["description"], len(t["columns"])) for t in things}
    got = [(r.source_id, r.target_id, r.dependency_type) for r in found.table_deps.orderBy("seq").collect()]
    assert got == [(e["source_id"], e["target_id"], e["dependency_type"]) for e in edges]
    assert [r.seq for r in found.table_deps.orderBy("seq").collect()] == list(range(len(edges)))
    got = [(r.source_column, r.target_object_id, r.transformation) for r in found.column_deps.orderBy("seq").collect()]
    assert got == [(c["source_column"], c["target_object_id"], c["transformation"]) for c in columns]


def test_one_element_over_many_blocks(spark, tmp_path, small_blocks):
    small_blocks(300)
    big = {"id": "S.B", "text": "}," * 500, "nested": [{"k": "}" * 30}] * 40}
    (tmp_path / "a.json").write_text(json.dumps({"objects": [{"id": "S.A"}, big, [1, {"x": 2}], 7, None, {"id": "S.C"}]}))
    rows = scan(spark, str(tmp_path / "a.json"), ["objects"]).where("kind = 'element'").orderBy("place").collect()
    assert [(r.place, json.loads(r.text)) for r in rows] == [(0, {"id": "S.A"}), (1, big), (2, [1, {"x": 2}]), (5, {"id": "S.C"})]


@pytest.mark.parametrize("text", ["", '{"a": {"b": 1}', '{"a": 1}}', '{"a": "b}', '{"metadata": {}, "objects": null, "dependencies": []}'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ValueError):
        cache.read_cache(spark, str(tmp_path / "b.json"))


def test_pieces_of_a_text():
    text = '{"a{": "x\\\\", "b": ["}", {"c": "\\"}"}]}'
    whole = [t for *_, t in _Pieces(False).tokens(text)]
    for cut in range(len(text)):
        if text[cut - 1] == "\\":
            continue
        p = _Pieces(False)
        assert [t for *_, t in p.tokens(text[:cut])] + [t for *_, t in p.tokens(text[cut:])] == whole
    s = Scanner(frozenset(["b"]), [])
    for c in ('{"b": [{"k": ', '1}, {"k": "', 'x"}]}'):
        s.feed(c)
    assert [(r[0], r[3], r[4]) for r in s.rows if r[0] == "element"] == [("element", 0, '{"k": 1}'), ("element", 1, '{"k": "x"}')]


def test_documents_are_json(spark, tmp_path):
    """What many tasks wrote is one valid document, with repeated edges, odd texts, and nothing at all."""
    doc, things, edges, columns = document(random.Random(3))
    (tmp_path / "in.json").write_text(json.dumps(doc))
    tables = cache.read_cache(spark, str(tmp_path / "in.json"))
    twice = cache.CacheTables(tables.objects, tables.table_deps.unionByName(tables.table_deps.limit(3)), tables.column_deps)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cache.write_document(twice, f"file://{tmp_path}/out.json", "here")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = json.loads((tmp_path / "out.json").read_text())
    assert got["metadata"] == {"source": "here", "object_count": 24, "column_count": sum(len(t["columns"]) for t in things), "dependency_count": 27}
    assert {k: v["name"] for k, v in got["objects"].items()} == {t["id"]: t["name"] for t in things} and list(got["objects"]) == sorted(got["objects"])
    assert len(got["dependencies"]["table_level"]) == 27 and len(got["dependencies"]["column_level"]) == len(columns)
    assert got["indexes"]["by_type"] == {"TABLE": sorted(t["id"] for t in things)}
    assert got["indexes"]["forward"] == {e["source_id"]: sorted({x["target_id"] for x in edges if x["source_id"] == e["source_id"]}) for e in edges}
    assert not list(tmp_path.glob("*.parts-*"))
    again = cache.read_cache(spark, f"file://{tmp_path}/out.json")
    assert sorted(again.objects.collect(), key=lambda r: r.id) == sorted(tables.objects.collect(), key=lambda r: r.id)
    none = cache.CacheTables(tables.objects.limit(0), tables.table_deps.limit(0), tables.column_deps.limit(0))
    cache.write_document(none, f"file://{tmp_path}/none.json")
    empty = json.loads((tmp_path / "none.json").read_text())
    assert empty["objects"] == {} and empty["dependencies"] == {"table_level": [], "column_level": []} and empty["indexes"] == dict.fromkeys(["by_schema", "by_type", "forward", "backward"], {})
