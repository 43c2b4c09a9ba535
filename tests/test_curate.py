import json

import pytest

from pairloom.operators import curate
from pairloom.schemas import FUNCTION_PAIRS, INSTRUCTION, UNNAMED_FUNCTION
from pairloom.plans.curate import merge_pair_files, write_input_output, write_instructions
from pairloom.sinks.tables import append_pairs, write_jsonl
from pairloom.sources.items import read_pairs
from pyspark.sql import functions as F


def pair(name, code, repo="o/a"):
    return dict(function_name=name, function_code=code, function_file="a.py", test_function_name=f"test_{name}",
                test_function_code="def t(): pass", test_function_file="t.py", repository=repo)


def write_lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    return str(path)


def test_first_of_each_name_over_files_and_repositories(spark, tmp_path):
    a = write_lines(tmp_path / "a.jsonl", [pair("main", "1"), pair("f", "2"), pair("main", "3", "o/b")])
    b = write_lines(tmp_path / "b.jsonl", [pair("g", "4"), pair("f", "5"), pair(None, "6"), pair(None, "7")])
    rows = merge_pair_files(spark, [a, b]).orderBy("ord").collect()
    assert [(r.function_name, r.function_code) for r in rows] == [("main", "1"), ("f", "2"), ("g", "4"), (None, "6")]
    rows = merge_pair_files(spark, [b, a]).orderBy("ord").collect()
    assert [(r.function_name, r.function_code) for r in rows] == [("g", "4"), ("f", "5"), (None, "6"), ("main", "1")]


def test_formats_agree(spark, tmp_path):
    rows = [pair(f"f{i % 50}", str(i)) for i in range(400)]
    lines = write_lines(tmp_path / "a.jsonl", rows)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=4, ensure_ascii=False), encoding="utf-8")
    spark.createDataFrame(rows, FUNCTION_PAIRS).coalesce(1).write.parquet(f"{tmp_path}/p")
    want = [str(i) for i in range(50)]
    for path, fmt in ((lines, "jsonl"), (f"{tmp_path}/a.json", "json"), (f"{tmp_path}/p", "parquet")):
        got = [r.function_code for r in merge_pair_files(spark, [path], fmt).orderBy("ord").collect()]
        assert got == want, fmt


def test_line_order_holds_over_many_splits(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [pair(f"f{i % 10}", str(i)) for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pairs = read_pairs(spark, [path])
        assert pairs.rdd.getNumPartitions() > 5
        assert [int(r.function_code) for r in pairs.orderBy("ord").collect()] == list(range(5000))
        assert sorted(int(r.function_code) for r in curate.keep_first(pairs).collect()) == list(range(10))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_keep_first_needs_its_columns(spark):
    with pytest.raises(ValueError, match="function_name"):
        curate.keep_first(spark.createDataFrame([(1,)], "ord int"))


def test_concatenate_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "ord int, k string"), spark.createDataFrame([(2,)], "ord int")
    assert [tuple(r) for r in curate.concatenate([a, b]).orderBy("ord").collect()] == [(1, "x"), (2, None)]


def items(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("item"))


def test_null_is_present_and_absent_is_skipped(spark):
    df = items(
        spark,
        '{"function_name":"a","function_code":"x","test_function_code":null}',
        '{"function_name":"b","function_code":"x"}',
        '{"test_function_code":"x"}',
        '{"function_name":null}',
    )
    got = [tuple(r) for r in curate.instruction_records(df).collect()]
    assert got == [(INSTRUCTION, "x", None)]
    assert sorted(r[0] or "" for r in curate.skipped_items(df).collect()) == sorted(["b", UNNAMED_FUNCTION, ""])
    assert tuple(df.agg(*curate.instruction_counts()).first()) == (1, 3)


def test_strict_records_fail_on_a_missing_key(spark):
    good = items(spark, '{"function_code":"x","test_function_code":null}')
    assert [tuple(r) for r in curate.input_output_items(good).collect()] == [("x", None)]
    with pytest.raises(Exception, match="missing key: test_function_code"):
        curate.input_output_items(items(spark, '{"function_code":"x"}')).collect()
    with pytest.raises(Exception):
        curate.input_output(spark.createDataFrame([("x",)], "function_code string"))


def read_lines(folder):
    lines = []
    for part in sorted(folder.glob("part-*")):
        lines += part.read_text(encoding="utf-8").splitlines()
    return lines


def test_json_lines_keep_nulls_key_order_and_raw_text(spark, tmp_path):
    df = spark.createDataFrame([("é漢", None), ("b", "2")], "z string, a string")
    write_jsonl(df, f"{tmp_path}/out", order=["z"])
    assert read_lines(tmp_path / "out") == ['{"z":"b","a":"2"}', '{"z":"é漢","a":null}']


def test_curation_jobs(spark, tmp_path):
    rows = [pair("f", "1"), pair("g", "2"), pair("f", "3")]
    path = write_lines(tmp_path / "a.jsonl", rows)
    write_input_output(spark, [path], f"{tmp_path}/io")
    assert [json.loads(x) for x in read_lines(tmp_path / "io")] == [{"input": c, "output": "def t(): pass"} for c in "12"]
    incomplete = pair("h", "4")
    del incomplete["test_function_code"]
    path = write_lines(tmp_path / "b.jsonl", [*rows, incomplete])
    assert write_instructions(spark, [path], f"{tmp_path}/ins") == {"converted": 2, "skipped": 1}
    got = [json.loads(x) for x in read_lines(tmp_path / "ins")]
    assert got == [{"instruction": INSTRUCTION, "input": c, "output": "def t(): pass"} for c in "12"]


def test_no_item_is_lost_for_want_of_a_name(spark, tmp_path):
    named, first, second = pair("f", "1"), pair("x", "2"), pair("x", "3")
    del first["function_name"], second["function_name"]
    path = write_lines(tmp_path / "a.jsonl", [named, first, second])
    for job in (write_input_output, write_instructions):
        with pytest.raises(Exception, match="missing key: function_name"):
            job(spark, [path], f"{tmp_path}/{job.__name__}")
    assert write_instructions(spark, [path], f"{tmp_path}/all", merge=False) == {"converted": 3, "skipped": 0}
    assert [json.loads(x)["input"] for x in read_lines(tmp_path / "all")] == ["1", "2", "3"]
    null = [dict(named, function_name=None, function_code=c) for c in "45"]
    path = write_lines(tmp_path / "b.jsonl", null)
    assert write_instructions(spark, [path], f"{tmp_path}/null") == {"converted": 1, "skipped": 0}
    del named["test_function_code"]
    path = write_lines(tmp_path / "c.jsonl", [named])
    with pytest.raises(Exception, match="missing key: test_function_code"):
        write_input_output(spark, [path], f"{tmp_path}/strict")


def test_append_adds_rows(spark, tmp_path):
    df = spark.createDataFrame([pair("f", "1")], FUNCTION_PAIRS)
    append_pairs(df, f"{tmp_path}/p")
    append_pairs(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
