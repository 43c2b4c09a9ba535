import json

import pytest
from pyspark.errors import AnalysisException

from pairloom.operators.validate import rejected_files, require_rows, split_valid_items, valid_files, with_content
from pairloom.schemas import FILE_LEDGER, REPO_LEDGER, REPO_STATS
from pairloom.session import scratch_root, spread, stored
from pairloom.sinks.tables import append_ledger
from pairloom.sources import files, items, state


def test_file_list_array(spark, tmp_path):
    entries = [
        {"repository_full_name": "o/a", "file_path": "t.py", "download_url": "u"},
        "text",
        {"file_path": "x.py"},
        {"repository_full_name": "", "file_path": "x.py"},
        {"repository_full_name": "o/b", "file_path": "é.py"},
    ]
    path = tmp_path / "list.json"
    path.write_text(json.dumps(entries, indent=2, ensure_ascii=False), encoding="utf-8")
    got = items.read_file_list(spark, str(path)).orderBy("file_pos").collect()
    assert [(r.file_pos, r.repository_full_name, r.file_path, r.download_url) for r in got] == [(0, "o/a", "t.py", "u"), (4, "o/b", "é.py", None)]
    bad = split_valid_items(items.read_items(spark, str(path), "json"))[1]
    assert sorted(r.reason for r in bad.collect()) == ["no repository", "no repository", "not an object"]


def test_file_list_lines(spark, tmp_path):
    path = tmp_path / "list.jsonl"
    path.write_text('{"repository_full_name":"o/b","file_path":"1"}\n\n{"repository_full_name":"o/a","file_path":"2"}\n')
    assert [r.file_path for r in items.read_file_list(spark, str(path), "jsonl").orderBy("ord").collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        items.read_items(spark, str(path), "xml")


def test_elements_of_any_kind_keep_their_place(spark, tmp_path):
    path = tmp_path / "mixed.json"
    path.write_text('[{"a":1}, "{\\"a\\":1}", null, [1], 2.5, {"a":null}]')
    got = items.read_items(spark, str(path), "json").selectExpr("ord.pos", "to_json(item) AS t").orderBy("pos").collect()
    assert [r.t for r in got] == ['{"a":1}', '"{\\"a\\":1}"', "null", "[1]", "2.5", '{"a":null}']


def test_array_beyond_the_limit_of_one_variant(spark, tmp_path):
    path = tmp_path / "large.json"
    with path.open("w") as out:
        for i in range(140):
            out.write("," if i else "[")
            out.write('{"repository_full_name":"o/a","file_path":"%d","download_url":"%s"}' % (i, "u" * 1_000_000))
        out.write("]")
    got = items.read_file_list(spark, str(path)).selectExpr("file_pos", "file_path", "length(download_url) AS n").collect()
    assert sorted((r.file_pos, int(r.file_path), r.n) for r in got) == [(i, i, 1_000_000) for i in range(140)]


def test_parts_are_in_order_of_their_numbers(spark, tmp_path):
    for name, text in {"part-100000-x.json": "c", "part-99999-x.json": "b", "part-00002-x.json": "a"}.items():
        (tmp_path / name).write_text(json.dumps({"function_name": text}) + "\n")
    got = items.read_pairs(spark, [str(tmp_path)]).orderBy("ord").collect()
    assert [r.function_name for r in got] == ["a", "b", "c"]


def test_typed_validation(spark):
    df = spark.createDataFrame([("o/a", "x"), (None, "y"), ("", "z")], "repository_full_name string, content string")
    assert valid_files(df).count() == 1 and rejected_files(df).count() == 2
    assert require_rows(df) is df
    with pytest.raises(ValueError):
        require_rows(df.limit(0))
    assert with_content(spark.createDataFrame([("",), (None,), ("x",)], "content string")).count() == 1


def test_absent_state_is_empty(spark, tmp_path):
    gone = f"{tmp_path}/gone"
    assert state.read_ledger(spark, gone).schema == REPO_LEDGER
    assert state.read_ledger(spark, gone, FILE_LEDGER).count() == 0
    assert state.read_pairs_or_empty(spark, gone).count() == 0
    assert state.read_stats(spark, gone).schema == REPO_STATS
    assert state.read_json_ledger(spark, gone).count() == state.read_log_ledger(spark, gone).count() == 0
    with pytest.raises(AnalysisException):
        state.or_empty(spark, lambda: spark.sql("select nothing"), REPO_LEDGER)


def test_ledgers_and_stats(spark, tmp_path):
    done = spark.createDataFrame([("o/a",)], REPO_LEDGER)
    append_ledger(done, f"{tmp_path}/ledger")
    append_ledger(spark.createDataFrame([("o/b",)], REPO_LEDGER), f"{tmp_path}/ledger")
    assert {r[0] for r in state.read_ledger(spark, f"{tmp_path}/ledger").collect()} == {"o/a", "o/b"}
    (tmp_path / "r.json").write_text('["o/a",\n "o/b"]')
    assert {r[0] for r in state.read_json_ledger(spark, f"{tmp_path}/r.json").collect()} == {"o/a", "o/b"}
    (tmp_path / "s.json").write_text('{"o/a": 4,\n "o/b": 0}')
    assert {tuple(r) for r in state.read_stats(spark, f"{tmp_path}/s.json").collect()} == {("o/a", 4), ("o/b", 0)}
    (tmp_path / "f.log").write_text("o/a:t/x.py\n o/a:t/x.py \n\no/b:C:y.py\n")
    assert {tuple(r) for r in state.read_log_ledger(spark, f"{tmp_path}/f.log").collect()} == {("o/a", "t/x.py"), ("o/b", "C:y.py")}


def test_checkouts(spark, tmp_path):
    for name, raw in {"own/repo/a.py": b"x = '\xff\xc3\xa9'", "own/repo/pkg/b.py": b"y", "own/other/c.txt": b"z"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    got = {tuple(r) for r in files.read_checkouts(spark, f"{tmp_path}/tree").collect()}
    assert got == {("own/repo", "a.py", "x = 'é'"), ("own/repo", "pkg/b.py", "y")}


def test_coverage_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('"TargetModule","Coverage"\n"source","1.0"\n"source","0.03125"\n')
    assert [tuple(r) for r in files.read_coverage(spark, f"{tmp_path}/c.csv").collect()] == [("source", 1.0), ("source", 0.03125)]


def test_scratch_comes_from_the_session(spark):
    root = scratch_root(spark)
    assert root == scratch_root(spark)
    assert stored(spark.range(3), "x").count() == 3
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    wide = spark.range(10).repartition(9)
    assert spread(wide) is wide
