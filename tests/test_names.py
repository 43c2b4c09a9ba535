from pairloom.functions.names import base_name, is_source_file, is_test, tree_order


def test_names(spark):
    names = ["test_add", "test_", "test", "TestX", "add_test", "test_test_foo"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select("name", is_test("name"), base_name("name")).collect()
    assert {r[0] for r in got if r[1]} == {"test_add", "test_", "test_test_foo"}
    assert {r[0]: r[2] for r in got if r[1]} == {"test_add": "add", "test_": "", "test_test_foo": "test_foo"}


def test_source_files(spark):
    paths = ["a.py", "src/latest/x.py", "Tests/a.py", "a.PY", "a.pyc", "pkg/conTEST.py", "pkg/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0] for r in df.where(is_source_file("path")).collect()} == {"a.py", "pkg/b.py"}


def test_tree_order_is_breadth_first(spark):
    paths = ["b.py", "a/z.py", "a/b/c.py", "a.py", "B/a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)
    got = [r[0] for r in df.orderBy(tree_order("path")).collect()]
    assert got == ["a.py", "b.py", "B/a.py", "a/z.py", "a/b/c.py"]
