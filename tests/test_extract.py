import ast
import glob
import os

from hypothesis import given, settings, strategies as st

from pairloom.functions.python_source import file_functions
from pairloom.operators.extract import collapse_in_file, extract_functions, parse_files, parse_report, extract_tests


def named(source, **kw):
    return [(r["name"], r["code"]) for r in file_functions(source, **kw) if r["name"] is not None]


def test_last_in_breadth_first_order_wins():
    source = "class A:\n    def f(self):\n        return 1\n\ndef f():\n    return 2\n"
    assert [code for _, code in named(source)] == ["def f():\n    return 2", "def f(self):\n        return 1"]
    assert named(source, last_only=True) == [("f", "def f(self):\n        return 1")]


def test_what_counts_as_a_function():
    source = "async def h():\n    pass\n\n@deco\n@other(1)\ndef g():\n    def inner(): pass\n    return inner\n"
    assert [n for n, _ in named(source)] == ["g", "inner"]
    assert named(source)[0][1].startswith("def g():")


def test_unparsable_files_give_their_status():
    for bad in ["print 'x'", "def f(): pass\0", "\ufeffdef f(): pass", "(" * 500 + ")" * 500, "\ud800"]:
        (row,) = file_functions(bad)
        assert row["name"] is None and row["parse_status"] in ("syntax_error", "error")
    deep = file_functions("x = " + "-" * 200_000 + "1")
    assert deep[0]["name"] is None
    assert file_functions("x = 1") == [dict(fn_pos=None, name=None, code=None, parse_status="ok")]


def test_segments_equal_the_standard_ones_on_library_files():
    folder = os.path.dirname(ast.__file__)
    checked = 0
    for path in sorted(glob.glob(f"{folder}/*.py"))[:60]:
        with open(path, encoding="utf-8", errors="ignore", newline="") as f:
            source = f.read()
        if len(source) > 60_000:
            continue
        nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]
        want = [(n.name, ast.get_source_segment(source, n)) for n in nodes]
        assert named(source) == want
        checked += len(want)
    assert checked > 300


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.sampled_from(["def f(a='é'):", "x = '漢字😀'", "    return 1", "\f", "# \u2028 c", "", "def g(): return '\t'", "if x:"]), max_size=8),
    st.sampled_from(["\n", "\r\n", "\r"]),
)
def test_segments_equal_the_standard_ones_on_odd_text(lines, newline):
    source = newline.join(lines)
    try:
        tree = ast.parse(source)
    except SyntaxError:
        assert file_functions(source)[0]["parse_status"] == "syntax_error"
        return
    want = [(n.name, ast.get_source_segment(source, n)) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
    assert named(source) == want


FILES = [
    ("o/a", "m.py", 0, "def add(a, b):\n    return a + b\n"),
    ("o/a", "test_m.py", 1, "def test_add():\n    assert 1\n\ndef helper(): pass\n"),
    ("o/a", "bad.py", 2, "def broken(:"),
    ("o/a", "empty.py", 3, ""),
    ("o/a", "absent.py", 4, None),
    ("o/a", "plain.py", 5, "x = 1"),
]


def files(spark):
    return spark.createDataFrame(FILES, "repository_full_name string, file_path string, file_pos long, content string")


def test_operators(spark):
    df = files(spark)
    got = {(r.file_path, r.name, r.is_test, r.base_name) for r in extract_functions(df).collect()}
    assert got == {("m.py", "add", False, "add"), ("test_m.py", "test_add", True, "add"), ("test_m.py", "helper", False, "helper")}
    assert [r.name for r in extract_tests(df).collect()] == ["test_add"]
    report = {r.parse_status: (r.num_files, r.num_functions) for r in parse_report(parse_files(df)).collect()}
    assert report == {"ok": (3, 3), "syntax_error": (1, 0)}


def test_in_file_collapse_equals_the_narrow_form(spark):
    source = "class A:\n    def f(self): return 1\n\ndef f(): return 2\n\ndef g(): return 3\n"
    df = spark.createDataFrame([("o/a", f"m{i}.py", i, source) for i in range(20)], files(spark).schema)
    columns = ["repository_full_name", "file_path", "name", "fn_pos", "code"]
    rows = collapse_in_file(extract_functions(df)).select(columns)
    assert sorted(rows.collect()) == sorted(extract_functions(df, last_only=True).select(columns).collect())


def test_only_content_crosses_to_python_and_filters_reach_the_scan(spark, tmp_path):
    files(spark).write.parquet(f"{tmp_path}/files")
    df = extract_functions(spark.read.parquet(f"{tmp_path}/files")).where("repository_full_name = 'o/a'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert "PushedFilters: [" in plan and "EqualTo(repository_" in plan


def test_bad_bytes_and_empty_files(spark):
    rows = spark.createDataFrame([(0, b"# \xff\ndef f(): pass"), (1, b""), (2, None), (3, b"x = 1")], "id int, raw binary")
    files = rows.selectExpr("id", "CAST(raw AS STRING) AS content")
    got = {(r.id, r.name, r.parse_status) for r in parse_files(files).collect()}
    assert got == {(0, "f", "ok"), (3, None, "ok")}
    got = {(r.id, r.name, r.parse_status) for r in parse_files(files, keep_empty=True).collect()}
    assert got == {(0, "f", "ok"), (1, None, "empty"), (2, None, "empty"), (3, None, "ok")}
