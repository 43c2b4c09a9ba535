import random

from pairloom.streaming.merged import MergedSet

SCHEMA = "function_name string, code string, file_ord int, pos long"


def rows_of(seed, n=300):
    """Names repeat, one is in a third of all rows, one is null; places are all different."""
    rng = random.Random(seed)
    names = ["main" if rng.random() < 0.3 else None if rng.random() < 0.05 else f"f{rng.randrange(60)}" for _ in range(n)]
    return [(name, f"code {i}", i % 4, i) for i, name in enumerate(names)]


def first_of_each(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[2:]):
        out.setdefault(row[0], row)
    return sorted(out.values(), key=repr)


def merged_set(spark, path, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    return MergedSet(spark, str(path), schema, order=["file_ord", "pos"], buckets=buckets)


def collected(merged):
    return sorted((tuple(r) for r in merged.rows().collect()), key=repr)


def test_any_order_of_arrival(spark, tmp_path):
    rows = rows_of(1)
    for number, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2])):
        merged = merged_set(spark, tmp_path / str(number))
        assert collected(merged) == [] and merged.merge(spark.createDataFrame([], SCHEMA)) is None
        seen = []
        for i, part in enumerate(order):
            new = [r for r in rows if r[2] == part]
            seen += new
            assert merged.merge(spark.createDataFrame(new, SCHEMA)) == i
            assert collected(merged) == first_of_each(seen)


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    merged = merged_set(spark, tmp_path, buckets=32)
    merged.merge(spark.createDataFrame(rows_of(2), SCHEMA))
    before = merged._current()
    merged.merge(spark.createDataFrame([("f1", "early", -1, 0)], SCHEMA))
    changed = {b for b, n in merged._current().items() if n != before[b]}
    assert len(changed) == 1 and merged.rows().where("function_name = 'f1'").first().code == "early"
    assert [r.bucket for r in merged.replaced().collect()] == list(changed)


def test_merges_again_and_after_a_crash(spark, tmp_path):
    rows = rows_of(3)
    merged = merged_set(spark, tmp_path)
    merged.merge(spark.createDataFrame(rows, SCHEMA))
    merged.merge(spark.createDataFrame(rows, SCHEMA))
    assert collected(merged) == first_of_each(rows)
    # A third merge that wrote rows and died before its log.
    stray = spark.createDataFrame([("main", "stray", -5, 0)], SCHEMA)
    for bucket in range(8):
        stray.write.parquet(f"{tmp_path}/rows/batch_id=2/bucket={bucket}")
    assert collected(merged) == first_of_each(rows)
    assert merged.merge(spark.createDataFrame([("new", "x", 0, 1)], SCHEMA)) == 2
    assert collected(merged) == first_of_each([*rows, ("new", "x", 0, 1)])
