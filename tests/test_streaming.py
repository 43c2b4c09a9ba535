import pytest

from pairloom.operators.extract import extract_functions
from pairloom.operators.pairing import pair_listed
from pairloom.streaming import dedup, incremental
from test_pairing import SCHEMA, brute_by_file, random_repository


def drop(spark, rows, landing):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(landing)


def pairs_of(spark, out):
    return sorted(tuple(r) for r in incremental.committed_pairs(spark, out).collect())


def whole(spark, rows):
    return sorted(tuple(r) for r in pair_listed(extract_functions(spark.createDataFrame(rows, SCHEMA))).collect())


def test_two_drops_equal_one_run(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = random_repository(11) + [("o/zero", "a.py", 0, "x = 1"), ("o/broken", "a.py", 0, "def (")]
    first, second = [r for r in rows if r[0] == "o/hot"], [r for r in rows if r[0] != "o/hot"]
    assert incremental.last_batch(spark, out) == -1
    drop(spark, first, landing)
    assert incremental.mine_available(spark, landing, out) == 0
    assert pairs_of(spark, out) == whole(spark, first)
    drop(spark, second, landing)
    assert incremental.mine_available(spark, landing, out) == 1
    assert incremental.mine_available(spark, landing, out) is None
    assert pairs_of(spark, out) == whole(spark, rows)
    stats = {r.repository: r.num_pairs for r in incremental.committed_stats(spark, out).collect()}
    assert set(stats) == {r[0] for r in rows} and stats["o/zero"] == stats["o/broken"] == 0
    assert sum(stats.values()) == len(whole(spark, rows))
    assert {r[0] for r in incremental.committed_repos(spark, out).collect()} == set(stats)


@pytest.mark.parametrize("lost", ["ledger", "stats"])
def test_a_run_that_died_before_its_ledger_is_repeated_once(spark, tmp_path, monkeypatch, lost):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = random_repository(12)
    drop(spark, rows, landing)
    write = incremental._write_batch

    def dying(rows, out, table, batch):
        if table == lost:
            raise RuntimeError("killed")
        return write(rows, out, table, batch)

    monkeypatch.setattr(incremental, "_write_batch", dying)
    with pytest.raises(RuntimeError):
        incremental.mine_available(spark, landing, out)
    assert pairs_of(spark, out) == []
    monkeypatch.setattr(incremental, "_write_batch", write)
    extra = [("o/late", "a.py", 0, "def f(): pass\ndef test_f(): pass")]
    drop(spark, extra, landing)
    assert incremental.mine_available(spark, landing, out) == 0
    assert pairs_of(spark, out) == whole(spark, rows + extra)


def test_parsing_twice_adds_nothing(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    drop(spark, random_repository(13), landing)
    incremental.start_parsing(spark, landing, out, 0).awaitTermination()
    parsed = spark.read.parquet(f"{out}/parsed").count()
    incremental.start_parsing(spark, landing, out, 0).awaitTermination()
    assert spark.read.parquet(f"{out}/parsed").count() == parsed


def test_mode_a_runs_add_up(spark, tmp_path):
    rows = random_repository(14)
    files = spark.createDataFrame(rows, SCHEMA)
    tests = files.where("file_path like 'tests/%'").drop("content")
    for part in (tests.where("file_pos % 3 = 0"), tests, tests):
        incremental.mine_new_test_files(spark, part, files.drop("file_pos"), f"{tmp_path}/out")
    got = sorted(tuple(r) for r in incremental.committed_data_pairs(spark, f"{tmp_path}/out").collect())
    assert got == brute_by_file(rows, [r for r in rows if r[1].startswith("tests/")])


def test_streaming_dedup_remembers_names_across_drops(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = spark.createDataFrame([], "function_name string, pos int").schema
    for start in (0, 5):
        spark.createDataFrame([(f"f{i % 8}", i) for i in range(start, start + 6)], schema).write.mode("append").parquet(landing)
        dedup.start_dedup(spark, landing, schema, out).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r.function_name for r in rows) == [f"f{i}" for i in range(8)]


def test_a_repository_split_over_drops_waits_for_its_files(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [("o/split", "a.py", 0, "def f(): pass"), ("o/whole", "b.py", 1, "def g(): pass\ndef test_g(): pass")]
    second = [("o/split", "t.py", 2, "def test_f(): pass")]
    expected = spark.createDataFrame([("o/split", 2), ("o/whole", 1)], "repository_full_name string, num_files long")
    drop(spark, first, landing)
    assert incremental.mine_available(spark, landing, out, expected) == 0
    assert pairs_of(spark, out) == whole(spark, first)
    assert incremental.mine_available(spark, landing, out, expected) is None
    drop(spark, second, landing)
    assert incremental.mine_available(spark, landing, out, expected) == 1
    assert pairs_of(spark, out) == whole(spark, first + second)
    assert incremental.mine_available(spark, landing, out, expected) is None


def test_unusable_and_empty_files(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [("o/a", "a.py", 0, "def f(): pass\ndef test_f(): pass"), ("", "b.py", 1, "def f(): pass\ndef test_f(): pass")]
    rows += [(None, "c.py", 2, "x"), ("o/empty", "d.py", 3, ""), ("o/null", "e.py", 4, None)]
    drop(spark, rows, landing)
    assert incremental.mine_available(spark, landing, out) == 0
    assert pairs_of(spark, out) == whole(spark, rows[:1])
    assert {tuple(r) for r in incremental.committed_stats(spark, out).collect()} == {("o/a", 1), ("o/empty", 0), ("o/null", 0)}
    assert {r[0] for r in incremental.committed_repos(spark, out).collect()} == {"o/a", "o/empty", "o/null"}
    assert {r.file_path for r in spark.read.parquet(f"{out}/rejected").collect()} == {"b.py", "c.py"}


def test_committed_file_list(spark, tmp_path):
    out = f"{tmp_path}/out"
    rows = random_repository(13)
    files = spark.createDataFrame(rows, SCHEMA)
    listed, contents = files.drop("content"), files.drop("file_pos")
    half = listed.where("repository_full_name = 'o/hot'")
    assert incremental.mine_file_list(spark, half, contents, out) == 0
    assert incremental.mine_file_list(spark, listed, contents, out) == 1
    assert incremental.mine_file_list(spark, listed, contents, out) is None
    assert pairs_of(spark, out) == whole(spark, rows)
    with pytest.raises(ValueError):
        incremental.mine_file_list(spark, listed.limit(0), contents, out)


def test_a_repository_over_three_drops_with_a_restart_between(spark, tmp_path, monkeypatch):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [
        [("o/slow", "a.py", 0, "def f(): pass"), ("o/now", "b.py", 1, "def g(): pass\ndef test_g(): pass")],
        [("o/slow", "b.py", 1, "def f(): return 1"), ("o/also", "c.py", 1, "def h(): pass\ndef test_h(): pass")],
        [("o/slow", "t.py", 2, "def test_f(): pass")],
    ]
    sizes = [("o/slow", 3), ("o/now", 1), ("o/also", 1)]
    expected = spark.createDataFrame(sizes, "repository_full_name string, num_files long")
    write = incremental._write_batch
    for batch, part in enumerate(parts):
        drop(spark, part, landing)

        def dying(rows, out, table, batch):
            if table == "ledger":
                raise RuntimeError("killed")
            return write(rows, out, table, batch)

        monkeypatch.setattr(incremental, "_write_batch", dying)
        with pytest.raises(RuntimeError):
            incremental.mine_available(spark, landing, out, expected)
        monkeypatch.setattr(incremental, "_write_batch", write)
        assert incremental.mine_available(spark, landing, out, expected) == batch
        names = {f.name for f in spark.read.parquet(f"{out}/open/batch_id={batch}").schema}
        assert names == {"repository_full_name", "file_path", "arrived"}
    assert pairs_of(spark, out) == whole(spark, sum(parts, []))
    assert spark.read.parquet(f"{out}/open/batch_id=2").isEmpty()
    assert incremental.mine_available(spark, landing, out, expected) is None
