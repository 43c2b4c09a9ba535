import pytest
from pyspark.sql import functions as F

from pairloom.streaming import commits
from pairloom.streaming.commits import CommittedTable


def table(spark, tmp_path, fan=3):
    return CommittedTable(spark, f"{tmp_path}/t", spark.range(0).withColumn("text", F.lit("")).schema, fan)


def part(spark, i, rows=4):
    return spark.range(i * 10, i * 10 + rows).withColumn("text", F.lit(f"batch {i}"))


def ids(t):
    return sorted(r.id for r in t.rows().collect())


def test_appends_count_once_and_folders_stay_few(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.rows().isEmpty() and t.keys().isEmpty() and t.remove_unused(0) == []
    want = []
    for i in range(12):
        assert t.append(part(spark, i), f"run {i}")
        assert not t.append(part(spark, i + 100), f"run {i}")
        want += range(i * 10, i * 10 + 4)
    assert ids(t) == want
    assert sorted(r.key for r in t.keys().collect()) == sorted(f"run {i}" for i in range(12))
    # 12 appends by threes: a folder of 9 and one of 3.
    names = t._folders(t._entries(t._last()))
    assert sorted(commits._level(n) for n in names) == [1, 2]
    t.remove_unused(keep_hours=0)
    assert sorted(p.name for p in (tmp_path / "t" / "rows").iterdir()) == names
    assert len(list((tmp_path / "t" / "log").glob("version=*"))) == 1
    assert len(list((tmp_path / "t" / "rows").glob("2-*/part-*"))) == 1
    assert ids(t) == want and not t.append(part(spark, 0), "run 0")
    assert t.append(part(spark, 20), "run 20") and len(ids(t)) == 52


@pytest.mark.parametrize("fails", ["append", "merge"])
def test_a_death_before_the_log_changes_nothing(spark, tmp_path, monkeypatch, fails):
    t = table(spark, tmp_path, fan=2)
    t.append(part(spark, 0), "a")
    commit, calls = CommittedTable._commit, []

    def dying(self, entries, version):
        calls.append(version)
        if len(calls) == (1 if fails == "append" else 2):
            raise RuntimeError("killed")
        commit(self, entries, version)

    monkeypatch.setattr(CommittedTable, "_commit", dying)
    with pytest.raises(RuntimeError):
        t.append(part(spark, 1), "b")
    monkeypatch.setattr(CommittedTable, "_commit", commit)
    seen = [0, 1, 2, 3] + ([10, 11, 12, 13] if fails == "merge" else [])
    assert ids(t) == seen
    # A folder nobody names is there, is young, and goes only when it is old.
    assert t.remove_unused() == [] and len(t.unused(0)) >= 1
    assert t.append(part(spark, 1), "b") == (fails == "append")
    t.compact()
    t.remove_unused(0)
    assert ids(t) == [0, 1, 2, 3, 10, 11, 12, 13] and len(t._folders(t._entries(t._last()))) == 1


def test_extra_columns_and_empty_appends(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.append(part(spark, 0, 0), "none") and not t.append(part(spark, 1), "none")
    assert t.append(part(spark, 1).withColumn("key", F.lit("x")).select("key", "text", "id"), "more")
    assert ids(t) == [10, 11, 12, 13] and t.rows().columns == ["id", "text"]
    with pytest.raises(ValueError):
        table(spark, tmp_path, fan=1)
