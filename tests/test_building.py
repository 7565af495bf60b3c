"""Text references, cache documents, streams, and the registered queries against DuckDB."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.functions import formats, sqltext
from tracewell.graph import LineageGraph
from tracewell.operators import build
from tracewell.sources import cache, corpus, sample
from tracewell.streaming import follow_edges

SF = "/root/testdata/sf0.001"


def refs(spark, sql, **kw):
    rows = spark.createDataFrame([(1, sql)], "k int, sql string")
    return {(r.ref_schema, r.ref_name, r.reference_type) for r in sqltext.table_refs(rows, ["k"], "sql", **kw).collect()}


def test_references(spark):
    cte = "WITH s AS (SELECT * FROM SHOP.RECEIPTS) SELECT * FROM s LEFT JOIN SHOP.MEMBERS c ON 1 = 1"
    assert refs(spark, cte) == {("SHOP", "RECEIPTS", "SELECT"), ("SHOP", "MEMBERS", "JOIN")}
    assert refs(spark, "CREATE TABLE S.T AS SELECT * FROM A.B") == {("S", "T", "DDL"), ("A", "B", "SELECT")}
    assert refs(spark, "SELECT 1 FROM DUAL, V_X JOIN SUM") == set()
    assert refs(spark, "DELETE FROM S.T") == {("S", "T", "SELECT")}
    assert refs(spark, "SELECT 1 FROM T", require_schema=True) == set()
    assert refs(spark, None) == set() and refs(spark, "") == set()


def test_references_in_many_shapes(spark):
    assert refs(spark, 'SELECT 1 FROM "Shop"."Basket Lines" b, `lake.raw.clicks` c, lake.raw.views v') == {("SHOP", "BASKET LINES", "SELECT"), ("RAW", "CLICKS", "SELECT"), ("RAW", "VIEWS", "SELECT")}
    assert refs(spark, "SELECT EXTRACT(DAY FROM b.T) FROM SHOP.B /* FROM SHOP.C */ -- JOIN SHOP.D") == {("SHOP", "B", "SELECT")}
    assert refs(spark, "MERGE INTO SHOP.B USING SHOP.C ON 1 = 1", by_statement=True) == {("SHOP", "B", "MERGE"), ("SHOP", "C", "SELECT")}
    assert refs(spark, "DELETE FROM SHOP.B", by_statement=True) == {("SHOP", "B", "DELETE")}


def test_long_texts_take_linear_time(spark):
    columns = ", ".join(f"t.C{k} AS N{k}" for k in range(5000))
    total = "+".join(f"t.c{k}" for k in range(15_000))
    views = [("wide", f"SELECT {columns} FROM SHOP.T t"), ("long", f"SELECT SUM({total}) AS S FROM SHOP.T t"), ("text", f"SELECT '{'x ' * 500_000}' AS L, t.A FROM SHOP.T t"), ("deep", f"SELECT {'(' * 3000}t.A{')' * 3000} AS D FROM SHOP.T t")]
    rows = spark.createDataFrame(views, "id string, sql string")
    counts = {r.id: r["count"] for r in sqltext.column_lineage(rows, "id", "sql").groupBy("id").count().collect()}
    assert counts == {"wide": 5000, "long": 15_000, "text": 1, "deep": 1}
    assert {r.ref_name for r in sqltext.table_refs(rows, ["id"], "sql").collect()} == {"T"}
    script = 'local a = "' + "y" * 1_000_000 + '"\nquery("SELECT 1 FROM SHOP.T")'
    found = sqltext.script_refs(spark.createDataFrame([("s", script, "LUA")], "id string, text string, language string"), ["id"], "text", "language").collect()
    assert [(r.ref_schema, r.ref_name) for r in found] == [("SHOP", "T")]


def test_shared_folder_is_asked_for_on_clusters():
    from types import SimpleNamespace

    from tracewell.storage import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_scripts(spark):
    lua = 'local a = query([[SELECT * FROM SHOP.BASKETS o JOIN SHOP.GOODS p ON 1=1]])\nquery("INSERT INTO " .. "BUFFER.DONE_BASKETS SELECT 1")'
    python = 'run("""SELECT * FROM DESK.WEEKLY v\nJOIN DESK.WEEKS t ON 1=1""")'
    rows = spark.createDataFrame([("l", lua, "LUA"), ("p", python, "PYTHON")], "id string, text string, language string")
    got = {(r.id, r.ref_schema, r.ref_name, r.reference_type) for r in sqltext.script_refs(rows, ["id"], "text", "language").collect()}
    assert got == {
        ("l", "SHOP", "BASKETS", "SELECT"), ("l", "SHOP", "GOODS", "JOIN"), ("l", "BUFFER", "DONE_BASKETS", "INSERT"),
        ("p", "DESK", "WEEKLY", "SELECT"), ("p", "DESK", "WEEKS", "JOIN"),
    }


def test_column_lineage(spark):
    sql = """SELECT o.BASKET_ID, c.MEMBER_NAME, SUM(o.AMOUNT) AS SPENT, CAST(o.DAY_OF AS DATE) AS DAY_OF,
    CASE WHEN o.STATUS = 'A' THEN 'x' ELSE 'y' END AS STATE_TEXT, UNQUALIFIED, COALESCE(o.A, NVL(o.A, 0)) AS TWICE FROM SALES.ORDERS o JOIN CUSTOMERS.CUSTOMER c ON o.C = c.C"""
    rows = spark.createDataFrame([("DWH.V", sql)], "id string, sql string")
    got = sorted((r.source_object_id, r.source_column, r.target_column, r.transformation_type) for r in sqltext.column_lineage(rows, "id", "sql").collect())
    assert got == sorted([
        ("SALES.ORDERS", "BASKET_ID", "BASKET_ID", "DIRECT"), ("CUSTOMERS.CUSTOMER", "MEMBER_NAME", "MEMBER_NAME", "DIRECT"), ("SALES.ORDERS", "AMOUNT", "SPENT", "AGGREGATE"),
        ("SALES.ORDERS", "DAY_OF", "DAY_OF", "CAST"), ("SALES.ORDERS", "STATUS", "STATE_TEXT", "CASE"), ("SALES.ORDERS", "A", "TWICE", "FUNCTION"), ("SALES.ORDERS", "A", "TWICE", "FUNCTION"),
    ])


def test_targets_and_formats(spark):
    texts = ["CREATE OR REPLACE VIEW p.d.v AS SELECT 1", "CREATE MATERIALIZED VIEW `d`.`v` AS SELECT 1", "SELECT 1", "create procedure d.p()"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(sqltext.create_target(F.col("s")).alias("t")).collect()
    assert [r.t and tuple(r.t) for r in rows] == [("p.d.v", "VIEW", "v"), ("d.v", "VIEW", "v"), None, ("d.p", "PROCEDURE", "p")]
    got = spark.range(1).select(formats.human_number(F.lit(1234567)), formats.human_bytes(F.lit(999)), formats.grouped_number(F.lit(1234567)), formats.type_label(F.lit("A_B_C"))).first()
    assert tuple(got) == ("1.2M", "999 B", "1,234,567", "A B_C")


def _object(i):
    return {"id": f"S.T{i}", "schema": "S", "name": f"T{i}", "type": "TABLE", "owner": "SYS", "object_id": i, "columns": [{"name": "a", "data_type": "INT"}], "unknown": 1}


def test_numbers_are_rounded_as_printf_does(spark):
    values = [0, 999, 1000, 1250, 1050, 1150, 12350, 1005, 2675, 519050, 999950, 999999, 1250000, 1005000000, 1125000000, (1 << 53) + 1, (1 << 63) - 1, -5, *range(1000, 400_000, 50)]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", formats.human_number(F.col("n")).alias("a"), formats.human_bytes(F.col("n")).alias("b")).collect()
    for r in rows:
        short, size = next(((f"{r.n / s:.1f}{a}", f"{r.n / s:.2f} {b}") for s, a, b in ((1e9, "B", "GB"), (1e6, "M", "MB"), (1e3, "K", "KB")) if r.n >= s), (str(r.n), f"{r.n} B"))
        assert (r.a, r.b) == (short, size), r.n


def test_cache_layouts(spark, tmp_path):
    deps = [{"source_id": "S.T1", "target_id": "S.T2"}, {"source": "S.T2", "target": "S.T3", "dependency_type": "ETL"}]
    layouts = {
        "map": {"objects": {f"S.T{i}": _object(i) for i in (1, 2, 3)}, "dependencies": {"table_level": deps, "column_level": [{"source_object_id": "S.T1", "source_column": "a", "target_object_id": "S.T2", "target_column": "a"}]}},
        "list": {"objects": [_object(i) for i in (1, 2, 3)], "dependencies": deps},
        "mapped": {"objects": [_object(i) for i in (1, 2, 3)], "dependencies": {"x": deps[0], "y": deps[1]}},
    }
    for name, document in layouts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"metadata": {}, **document}))
        found = cache.read_cache(spark, str(path))
        assert {r.id for r in found.objects.collect()} == {"S.T1", "S.T2", "S.T3"}
        assert {(r.source_id, r.target_id, r.dependency_type, r.reference_type) for r in found.table_deps.collect()} == {("S.T1", "S.T2", "DATA", "SELECT"), ("S.T2", "S.T3", "ETL", "SELECT")}
        assert found.column_deps.count() == (name == "map")
    cache.cache_document(cache.read_cache(spark, str(tmp_path / "map.json"))).write.text(str(tmp_path / "out"))
    assert cache.read_cache(spark, str(tmp_path / "out")).table_deps.count() == 2
    (tmp_path / "bad.json").write_text(json.dumps({"metadata": {}, "objects": {}}))
    with pytest.raises(ValueError):
        cache.read_cache(spark, str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        cache.read_cache(spark, str(tmp_path / "none.json"))


def test_sql_files(spark, tmp_path):
    folder = tmp_path / "repos" / "shop" / "bigquery"
    folder.mkdir(parents=True)
    (folder / "v.sql").write_text("CREATE VIEW d.v AS\nSELECT * FROM d.t")
    (folder / "notes.txt").write_text("no")
    files = corpus.read_sql_files(spark, str(tmp_path / "repos"), "bigquery")
    assert files.select("repo").first().repo == "shop"
    assert [tuple(r) for r in corpus.check_folder(spark, str(tmp_path / "repos"), "bigquery").collect()] == [("shop", 1)]
    assert corpus.check_folder(spark, str(tmp_path / "repos"), "none").count() == 0
    objects, edges = build.corpus_graph(files)
    assert [r.id for r in objects.collect()] == ["BIGQUERY.D.V"]
    assert [(r.source_id, r.target_id) for r in edges.collect()] == [("BIGQUERY.D.T", "BIGQUERY.D.V")]


def test_sample_and_numbers(spark):
    a, b = sample.sample_graph(spark, 200), sample.sample_graph(spark, 200)
    assert a.table_deps.exceptAll(b.table_deps).isEmpty() and a.objects.count() > 180
    ids = a.objects.select("id")
    assert a.table_deps.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").isEmpty()
    walked = LineageGraph(a.objects, a.table_deps, a.column_deps).lineage_of(spark.createDataFrame([(f"CHAIN.CHAIN_{c:02d}_00",) * 2 for c in range(5)], "seed string, id string"), 11)
    assert walked.nodes.groupBy("seed").agg(F.max("level").alias("l"), F.count("id").alias("n")).where("l = 11 AND n = 12").count() == 5
    numbers = [r.object_id for r in cache.numbered(a.objects.select("id"), ["id"]).orderBy("id").collect()]
    assert numbers == list(range(100_000, 100_000 + len(numbers)))


def test_stream_of_edges(spark, tmp_path):
    def send(name, rows):
        spark.createDataFrame(rows, "source_id string, target_id string, dependency_type string, reference_type string, seq long").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    schema = "source_id string, target_id string, dependency_type string, reference_type string, seq long"
    incoming, stored = str(tmp_path / "in" / "*"), str(tmp_path / "stored")
    send("a", [("A", "B", "ETL", "SELECT", 1), ("A", "B", "VIEW", "SELECT", 2)])
    follow_edges(spark, incoming, stored, str(tmp_path / "cp")).awaitTermination()
    send("b", [("A", "B", "NEW", "SELECT", 1), ("B", "C", "ETL", "SELECT", 2)])
    follow_edges(spark, incoming, stored, str(tmp_path / "cp")).awaitTermination()
    got = {(r.source_id, r.target_id, r.dependency_type) for r in spark.read.schema(schema).parquet(stored).collect()}
    assert got == {("A", "B", "ETL"), ("B", "C", "ETL")}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=str)

    assert rows(got) == rows(want)
