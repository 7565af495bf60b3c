"""SQL that scripts put together, dialects, and names that look like words."""

import pytest

from tracewell.functions import sqltext

LUA, PYTHON = "LUA", "PYTHON"
CASES = [
    (LUA, 'query("SELECT a FROM " .. sch .. ".T JOIN A.B ON 1=1 " .. x .. " JOIN C.D")', {"A.B", "C.D"}),
    (LUA, 'q("SELECT 1 FROM A." .. t .. " JOIN C.D ON a=b")', {"C.D"}),
    (LUA, 'local a = "SELECT 1 FROM X.Y" .. f("SELECT 2 FROM IN.NER", k["FROM N.O"]) .. " JOIN Z.W"\nlocal b = "JOIN NO.NE" -- "SELECT 3 FROM COM.MENT"', {"X.Y", "IN.NER", "Z.W"}),
    (LUA, '--[[ "SELECT 1 FROM COM.MENT" ]] exa.query([=[INSERT INTO B.C SELECT * FROM D.E]=], {a="x"})', {"B.C", "D.E"}),
    (LUA, 'f("SELECT 1 FROM A.B")("JOIN NO.NE")\ng({"SELECT 1 FROM", "P.Q"})', {"A.B"}),
    (LUA, "s = 'SELECT \"q\" FROM A.B' .. [[ JOIN C.D]] .. tostring(1 + 2) .. ' JOIN E.F'", {"A.B", "C.D", "E.F"}),
    (LUA, 'a = "it\\"s SELECT 1 FROM A.B" .. "JOIN C.D"', {"A.B", "C.D"}),
    (PYTHON, 'x = "SELECT * FROM A.B" " JOIN C.D ON 1=1"', {"A.B", "C.D"}),
    (PYTHON, 'x = ("SELECT * FROM A.B"\n   " JOIN C.D ON {z} = 1"  # "JOIN COM.MENT"\n + name + " JOIN E.F")\n"JOIN NOT.ME"', {"A.B", "C.D", "E.F"}),
    (PYTHON, 'x = f"SELECT * FROM {a}.T JOIN C.D ON {{b}}" \\\n  f" JOIN E_{n}.F, {q} JOIN G.H"\n', {"C.D", "G.H"}),
    (PYTHON, "z = rf'''UPDATE K.L SET a = \"b\"'''\nd = {'q': 'SELECT 1 FROM A.B', 'r': 'C.D'}", {"K.L", "A.B"}),
    (PYTHON, 'run("SELECT a\\nFROM E.F", "JOIN Z.Z")\nrun(x + "SELECT 1 FROM S_" + y)', {"E.F", "S_"}),
    (LUA, None, set()), (PYTHON, "", set()), (None, 'query("SELECT 1 FROM A.B")', {"A.B"}), (LUA, '"unclosed SELECT 1 FROM A.B', set()), (PYTHON, "f(()))(((", set()),
]


def test_script_chains(spark):
    rows = spark.createDataFrame([(k, lang, text) for k, (lang, text, _) in enumerate(CASES)], "k int, language string, text string")
    got: dict = {k: set() for k in range(len(CASES))}
    for r in sqltext.script_refs(rows, ["k"], "text", "language").collect():
        got[r.k].add(".".join(x for x in (r.ref_schema, r.ref_name) if x))
    for k, (_, text, want) in enumerate(CASES):
        assert got[k] == want, text


def test_long_scripts_take_linear_time(spark):
    chain = " .. ".join(f'" JOIN S.T{k}"' for k in range(20_000))
    rows = spark.createDataFrame([(1, "LUA", f'q("SELECT 1 FROM A.B" .. {chain})'), (2, "PYTHON", "(" * 20_000 + '"SELECT 1 FROM A.B"' + ")" * 20_000)], "k int, language string, text string")
    found = sqltext.script_refs(rows, ["k"], "text", "language").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in found} == {1: 20_001, 2: 1}


@pytest.mark.parametrize(
    "dialect,sql,want",
    [
        ("bigquery", "SELECT 1 FROM A.B # from X.Y\n JOIN C.D ON a = \"it's FROM E.F\" AND b = 'x\\' FROM G.H' JOIN `p-q.r.s` ON '''a ' FROM Z.Z''' = 1", {"A.B", "C.D", "R.S"}),
        ("mysql", "SELECT 1 FROM A.B # from X.Y\n WHERE a = 'x\\'y FROM N.O'", {"A.B"}),
        ("snowflake", "SELECT 1 FROM A.B // FROM X.Y\n JOIN C.D ON $$ FROM E.F ' $$ = 'a\\' FROM G.H'", {"A.B", "C.D"}),
        ("redshift", 'SELECT $x$ FROM E.F $x$ FROM "A b"."C" -- FROM q.r', {"A B.C"}),
        ("exasol", "SELECT 'a''FROM X.Y' FROM \"S\".\"T\"", {"S.T"}),
        ("unheard of", "SELECT $$ FROM E.F $$ FROM A.B", {"A.B"}),
        (None, "SELECT 1 FROM A.B JOIN S.DATE JOIN S.V_X JOIN DATE JOIN V_X JOIN SEQUENCE", {"A.B", "S.DATE", "S.V_X", "SEQUENCE"}),
    ],
)
def test_dialects(spark, dialect, sql, want):
    rows = spark.createDataFrame([(1, sql)], "k int, sql string")
    found = sqltext.table_refs(rows, ["k"], "sql", dialect=dialect).collect()
    assert {".".join(x for x in (r.ref_schema, r.ref_name) if x) for r in found} == want
    strict = sqltext.table_refs(rows, ["k"], "sql", dialect=dialect, strict_names=True).collect()
    assert {r.ref_name for r in strict} == {w.split(".")[-1] for w in want} - {"DATE", "V_X"}


def test_columns_by_dialect(spark):
    rows = spark.createDataFrame([(1, "SELECT t.A AS X, # t.B AS Y,\n t.C AS Z FROM S.T t")], "k int, sql string")
    found = sqltext.column_lineage(rows, "k", "sql", dialect="bigquery").collect()
    assert {(r.source_object_id, r.source_column, r.target_column) for r in found} == {("S.T", "A", "X"), ("S.T", "C", "Z")}


def test_tokens_are_neither_sorted_nor_shuffled(spark):
    """What is read of a text is settled in its row, so no row per token is sorted, spilled or sent."""
    rows = spark.createDataFrame([(1, "WITH w AS (SELECT 1 FROM A.B) SELECT t.X AS Y, u.Z FROM S.T t JOIN w u ON 1 = 1", "LUA")], "k int, sql string, language string")
    found = {
        "refs": sqltext.table_refs(rows, ["k"], "sql"), "columns": sqltext.column_lineage(rows, "k", "sql"), "scripts": sqltext.script_refs(rows, ["k"], "sql", "language"),
    }
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan, name
        assert plan.count("Exchange") == (2 if name == "scripts" else 1), name
    assert {(r.ref_schema, r.ref_name) for r in found["refs"].collect()} == {("A", "B"), ("S", "T")}
    assert {(r.source_object_id, r.source_column, r.target_column) for r in found["columns"].collect()} == {("S.T", "X", "Y"), ("W", "Z", "Z")}
