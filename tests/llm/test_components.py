import random

import pyarrow as pa
import pytest

from pairloom.llm import components as cc
from pairloom.llm.frames import most_frequent, sorted_groups


def brute(edges):
    parent = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            cc.union(parent, a, b)
            parent.setdefault(min(a, b), cc.find(parent, min(a, b)))
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    return {n: cc.find(parent, n) for n in nodes}


def graphs():
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    yield "chain", chain
    yield "hub", [(5000, i) for i in range(200)] + [(i, 6000 + i) for i in range(200)]
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    yield "odd", [(1, 1), (None, 2), (3, None), (-4, 9), (9, -4), (-4, 9)]
    yield "empty", []


@pytest.mark.parametrize("name,edges", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_components_equal_union_find(spark, monkeypatch, name, edges):
    monkeypatch.setattr(cc, "LOCAL_EDGES", 8)  # little is contracted before the rounds
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = [tuple(r) for r in cc.components(df).collect()]
    assert dict(got) == brute(edges) and len(got) == len(brute(edges))


def test_sorted_groups_join_rows_across_batches():
    keys = [1, 1, 2, 2, 2, 3, 5, 5]
    rows = pa.table({"k": keys, "j": [0, 0, 0, 1, 1, 1, 1, 1], "v": range(8)})
    for size in (1, 2, 3, 8):
        groups = list(sorted_groups(iter(rows.to_batches(size)), ["k", "j"]))
        assert [g["v"].to_pylist() for g in groups] == [[0, 1], [2], [3, 4], [5], [6, 7]]
    assert list(sorted_groups(iter([]), ["k"])) == []


def test_most_frequent_takes_whole_bands_up_to_the_bound(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([100] * 3 + [50] * 4 + [2] * 5 + [1] * 90)], "word int, n long")
    for keep, want in ((2, 0), (3, 3), (6, 3), (7, 7), (12, 12), (101, 12), (102, 102), (1000, 102)):
        assert most_frequent(rows, "n", keep).count() == want
    assert most_frequent(rows.limit(0), "n", 5).count() == 0
