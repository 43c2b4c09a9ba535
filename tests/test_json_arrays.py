import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from pairloom.sources import json_arrays
from pairloom.sources.items import read_items
from pairloom.sources.state import read_stats


@pytest.fixture
def ranges(spark):
    """Sets the size of the byte ranges that tasks read."""

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def elements(spark, path):
    rows = json_arrays.array_elements(spark, str(path)).collect()
    return {(r.part.rsplit("/", 1)[-1], r.pos): json.loads(r.text) for r in rows}, rows


def awkward(seed, n):
    """Brackets, commas, quotes and backslashes inside of texts, nested values, scalars."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "中", "\n", "a", " "]) for _ in range(rng.randint(0, 40)))
    makes = [text, lambda: {text(): [text(), {"k": text()}]}, lambda: rng.randint(-5, 5), lambda: None, lambda: [], lambda: [[text()], {}], lambda: rng.random()]
    return [rng.choice(makes)() for _ in range(n)]


@pytest.mark.parametrize("size", [300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 4])
def test_elements_over_ranges_of_any_size(spark, tmp_path, ranges, size, indent):
    ranges(size)
    for seed in (1, 2):
        values = awkward(seed, 150)
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(values, indent=indent, ensure_ascii=seed == 1), encoding="utf-8")
        got, rows = elements(spark, path)
        assert len(rows) == len(got) == len(values)
        assert [got[path.name, i] for i in range(len(values))] == values


def test_portions_and_batches_cut_elements(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(json_arrays, "SCANNED_AT_ONCE", 30)
    values = awkward(3, 200)
    (tmp_path / "a.json").write_text(json.dumps(values))
    got, _ = elements(spark, tmp_path / "a.json")
    assert [got["a.json", i] for i in range(200)] == values


def test_an_element_over_many_ranges(spark, tmp_path, ranges):
    ranges(500)
    values = [1, {"code": "x, [" * 3000}, 2]
    (tmp_path / "a.json").write_text(json.dumps(values))
    got, _ = elements(spark, tmp_path / "a.json")
    assert [got["a.json", i] for i in range(3)] == values


def test_several_files_and_small_arrays(spark, tmp_path, ranges):
    texts = {"a.json": "[]", "b.json": " [ \n] ", "c.json": "[7]", "d.json": '["x"]\n', "e.json": "", "f.json": "[[],[1,[2]]]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got, _ = elements(spark, tmp_path)
    assert got == {("c.json", 0): 7, ("d.json", 0): "x", ("f.json", 0): [], ("f.json", 1): [1, [2]]}


@pytest.mark.parametrize("text", ["[1, 2", '["a, 2]', '{"a": 1}', "7", "[1,]", "[1] 2"])
def test_what_is_not_an_array_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises((ValueError, PySparkException, Py4JJavaError)):
        read_items(spark, str(tmp_path / "a.json"), "json").collect()


def test_many_tasks_read_one_file(spark, tmp_path, ranges):
    ranges(20_000)
    (tmp_path / "a.json").write_text(json.dumps([{"i": i, "t": "x,y" * 50} for i in range(2000)]))
    records = json_arrays._records(spark, f"{tmp_path}/a.json")
    assert records.rdd.getNumPartitions() > 10
    entries = json_arrays.range_entries(records).orderBy("block").collect()
    assert len(entries) > 10 and [e.pos for e in entries] == sorted(e.pos for e in entries)
    assert {e.last for e in entries} == {1999}


def test_members_of_an_object(spark, tmp_path, ranges):
    ranges(200)
    values = {f"o/r{i}, {{{i}": i for i in range(100)}
    (tmp_path / "s.json").write_text(json.dumps(values, indent=4))
    rows = json_arrays.object_members(spark, f"{tmp_path}/s.json").collect()
    assert {k: v for r in rows for k, v in json.loads("{" + r.text + "}").items()} == values
    assert sorted(tuple(r) for r in read_stats(spark, f"{tmp_path}/s.json").collect()) == sorted(values.items())
