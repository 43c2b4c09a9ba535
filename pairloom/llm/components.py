"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped minima and two joins; a hub's rows meet in partial
aggregates and in joins that Spark splits when they are skewed. Rounds are
written to the scratch folder, so a lost executor repeats one step at most.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import stored

LOCAL_EDGES = 1 << 18


def union(parent: dict, a: int, b: int) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def find(parent: dict, a: int) -> int:
    root = a
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(a, a) != root and a != root:
        parent[a], a = root, parent[a]
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars around local roots; memory is bounded by LOCAL_EDGES."""
    parent: dict[int, int] = {}

    def stars() -> pa.RecordBatch:
        nodes = [n for n in parent if find(parent, n) != n]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(parent, n) for n in nodes], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                union(parent, a, b)
        if len(parent) > LOCAL_EDGES:
            yield stars()
            parent = {}
    yield stars()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    ``edges`` has two long columns; null ends and loops are ignored. An empty
    table gives an empty table.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = stored(edges.mapInArrow(_contract, "a long, b long").distinct(), label)
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)), label)
        now = _state(edges)
        if now == state:
            break
        state = now
    # Stars now: every node points at its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a")
        .select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        .select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))
        .where("a != b")
        .distinct()
    )
