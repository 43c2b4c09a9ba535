import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import split as split_module
from pairloom.operators.split import assign_split, rank_in, shard_size, split_sizes, with_position
from pairloom.sinks.tables import write_splits


def numbers(spark, n):
    values = list(range(n))
    random.Random(n).shuffle(values)
    return spark.createDataFrame([(v % 3, v) for v in values], "a int, b int").repartition(5)


@pytest.mark.parametrize("total,n,sizes", [(11, 5, [3, 3, 3, 2, 0]), (0, 3, [0, 0, 0]), (2, 5, [1, 1, 0, 0, 0]), (7, 1, [7])])
def test_sizes(spark, total, n, sizes):
    df = spark.range(total).select("id")
    assert [r.num_rows for r in split_sizes(df, n).orderBy("split").collect()] == sizes
    placed = {}
    for r in assign_split(df, ["id"], n).collect():
        placed[r.split] = placed.get(r.split, 0) + 1
    assert [placed.get(i, 0) for i in range(1, n + 1)] == sizes


def test_no_shards_is_an_error(spark):
    for call in (lambda: assign_split(spark.range(3), ["id"], 0), lambda: split_sizes(spark.range(3), 0), lambda: shard_size(3, -1)):
        with pytest.raises(ValueError):
            call()


def test_positions_follow_the_order(spark):
    got = with_position(numbers(spark, 1000), ["a", "b"], ranges=7).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000))
    assert [(r.a, r.b) for r in got] == sorted((v % 3, v) for v in range(1000))


def test_shards_concatenate_to_the_input(spark):
    got = assign_split(numbers(spark, 500), ["a", "b"], 7).collect()
    rows = sorted((r.a, r.b, r.split) for r in got)
    assert [s for *_, s in rows] == [i // shard_size(500, 7) + 1 for i in range(500)]


def test_rows_are_not_shuffled_to_place_them(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 as payload").write.parquet(f"{tmp_path}/t")
    df = assign_split(spark.read.parquet(f"{tmp_path}/t"), ["id"], 4)
    main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main


@pytest.mark.parametrize("tree", [0, 16])
def test_rank_in_bounds(spark, monkeypatch, tree):
    monkeypatch.setattr(split_module, "TREE", tree)
    bounds = [2, 5, 5, 9]
    df = spark.range(-1, 12).withColumn("b", F.array(*map(F.lit, bounds)))
    for row in df.select("id", rank_in(F.col("b"), F.col("id"), 6).alias("rank")).collect():
        assert row.rank == sum(b <= row.id for b in bounds)


@pytest.mark.parametrize("sample,n", [(64, 7), (500, 40), (8, 3), (1, 5), (5000, 9), (64, 5000)])
def test_any_sample_gives_the_same_shards(spark, monkeypatch, sample, n):
    monkeypatch.setattr(split_module, "SAMPLE", sample)
    total = 3000
    values = [(None if v < 5 else "h" if v % 3 else f"k{v % 11}", v) for v in range(total)]
    random.Random(4).shuffle(values)
    got = assign_split(spark.createDataFrame(values, "a string, b int").repartition(6), ["a", "b"], n).collect()
    rows = sorted(((r.a is not None, r.a or "", r.b), r.split) for r in got)
    assert [s for _, s in rows] == [i // shard_size(total, n) + 1 for i in range(total)]


def test_only_keys_near_a_bound_are_sorted(spark, monkeypatch):
    sorted_rows = []
    place = split_module.with_position
    monkeypatch.setattr(split_module, "with_position", lambda df, *a: sorted_rows.append(df.count()) or place(df, *a))
    monkeypatch.setattr(split_module, "SAMPLE", 10_000)
    placed = assign_split(spark.range(200_000), ["id"], 5)
    assert sorted_rows[0] < 4 * 2 * 200_000 * 300 / 10_000
    assert [r[0] for r in placed.groupBy("split").agg(F.count("*")).select("count(1)").collect()] == [40_000] * 5


def test_empty_shards_are_written(spark, tmp_path):
    write_splits(spark.range(11), f"{tmp_path}/s", ["id"], 5)
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == [f"split={i}" for i in range(1, 6)]
    for i, want in enumerate(([0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10], []), start=1):
        assert [r.id for r in spark.read.schema("id long").json(f"{tmp_path}/s/split={i}").collect()] == want
    write_splits(spark.range(0), f"{tmp_path}/none", ["id"], 2)
    assert sorted(p.name for p in (tmp_path / "none").glob("split=*")) == ["split=1", "split=2"]
