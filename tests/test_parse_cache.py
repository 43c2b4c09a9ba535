import pytest

from pairloom.operators.extract import extract_functions, parse_files
from pairloom.sources import bucketed
from pairloom.streaming.parse_cache import ParseCache
from test_pairing import fn, make, plan_of, random_repository


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def repeated_contents(seed):
    """Files of a repository, forks with the same texts, one text in a third of all files, files listed twice."""
    rows = random_repository(seed)
    forks = [("o/fork" + str(i), r[1], r[2] + 1000 * i, r[3]) for i in (1, 2) for r in rows[:40]]
    hot = [(f"o/r{i % 7}", f"pkg{i}/__init__.py", 5000 + i, fn("shared", 1)) for i in range(100)]
    return rows + forks + hot + rows[:10] + hot[:3] + [("o/a", "e.py", 9000, ""), ("o/a", "n.py", 9001, None)]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_runs_over_overlapping_files(spark, tmp_path, bound):
    rows = repeated_contents(1)
    cache = ParseCache(spark, f"{tmp_path}/cache")
    assert cache.last_batch() == -1 and cache.functions(make(spark, rows), bound).count() == 0
    assert cache.add(make(spark, rows[::2]), bound) == 0
    assert rows_of(cache.parsed(make(spark, rows[::2]), bound)) == rows_of(parse_files(make(spark, rows[::2])))
    assert cache.add(make(spark, rows), bound) == 1
    assert cache.add(make(spark, rows), bound) is None
    assert rows_of(cache.functions(make(spark, rows), bound)) == rows_of(extract_functions(make(spark, rows)))
    found = [(r.batch_id, bytes(r.content_key)) for r in cache.index().collect()]
    assert len(found) == len({k for _, k in found}) == len({r[3] for r in rows if r[3]})
    assert sum(b == 0 for b, _ in found) == len({r[3] for r in rows[::2] if r[3]})


def test_a_run_that_died_is_repeated(spark, tmp_path):
    rows = repeated_contents(2)
    cache = ParseCache(spark, f"{tmp_path}/cache")
    cache.add(make(spark, rows[:50]))
    # Functions of a second batch without its index.
    parse_files(make(spark, [("o/x", "x.py", 1, fn("stray", 1))]).selectExpr("unhex('00') AS content_key", "content")).write.parquet(f"{tmp_path}/cache/functions/batch_id=1")
    assert cache.add(make(spark, rows)) == 1
    assert rows_of(cache.functions(make(spark, rows))) == rows_of(extract_functions(make(spark, rows)))


def test_bucketed_tables_join_without_moving_contents(spark, tmp_path):
    files = make(spark, random_repository(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed.write_bucketed(files.drop("content").where("file_pos % 2 = 0"), "pairloom_t_list", f"{tmp_path}/list", 4)
        bucketed.write_bucketed(files.drop("file_pos"), "pairloom_t_contents", f"{tmp_path}/contents", 4)
        got = bucketed.attach_bucketed_content(spark, "pairloom_t_list", "pairloom_t_contents")
        assert "Exchange" not in plan_of(got) and "Sort" not in plan_of(got)
        names = files.columns
        assert rows_of(got.select(*names)) == rows_of(files.where("file_pos % 2 = 0"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS pairloom_t_list")
        spark.sql("DROP TABLE IF EXISTS pairloom_t_contents")
