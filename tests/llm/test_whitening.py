import math

import numpy as np
import pytest

from pairloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, whitened string, total string"


def table(spark, rows, parts=3):
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "c", "w", "t") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def vectors(n, dimension, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    scale = np.linspace(1, 2, dimension) if spread is None else np.asarray(spread)
    return ((rng.standard_normal((n, dimension)) * scale) @ turn + rng.standard_normal(dimension)).astype(np.float32)


def brute(data, k):
    x = np.floor(data.astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (x - s // n) - (s % n) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    return centred @ parts / np.sqrt(values), values / np.trace(centred.T @ centred / n), deviation


def check(got, ids, data, k, tolerance=1e-8):
    white, explained, deviation = brute(data, k)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * k
    found = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < tolerance
    for place, i in enumerate(ids):
        for c in range(1, k + 1):
            row = by[i, c]
            assert row.n == len(ids) and row.deviation == deviation[place]
            assert row.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert row.identity_error < 1e-8


@pytest.mark.parametrize("dimension", [5, 40, 100])
def test_equals_a_full_decomposition(spark, dimension):
    data = vectors(700, dimension)
    got = whitening.whitening(table(spark, list(enumerate(data.tolist())))).collect()
    check(got, list(range(700)), data, min(8, dimension))


def test_close_eigenvalues_need_the_filter(spark):
    data = vectors(3000, 80, spread=np.r_[1.08, 1.07, 1.06, np.ones(77)])
    got = whitening.whitening(table(spark, list(enumerate(data.tolist())))).collect()
    check(got, list(range(3000)), data, 8, 1e-6)


def test_passes_are_few(monkeypatch):
    matrix = np.diag(np.r_[np.linspace(40, 20, 8), np.linspace(10, 1, 500)])
    calls = []
    values, parts = whitening.leading(lambda q: (calls.append(1), matrix @ q)[1], len(matrix), 8)
    assert values == pytest.approx(np.linspace(40, 20, 8))
    assert np.abs(np.abs(parts[:8]) - np.eye(8)).max() < 1e-9
    assert len(calls) < 40


def test_equal_eigenvalues_end_at_the_rounding(monkeypatch):
    matrix = np.diag(np.r_[5.0, 5.0, 5.0, np.ones(97)])
    values, parts = whitening.leading(lambda q: matrix @ q, 100, 3)
    assert values == pytest.approx([5, 5, 5])
    assert np.abs(np.linalg.norm(parts[:3], axis=0) - 1).max() < 1e-9


def test_sums_do_not_depend_on_many_tasks(spark):
    data = vectors(400, 6)
    rows = list(enumerate(data.tolist()))
    few = {(r.vec_id, r.component): r for r in whitening.whitening(table(spark, rows, 2)).collect()}
    spread_out = whitening.whitening(table(spark, rows, 100)).collect()
    for r in spread_out:
        assert abs(r.whitened) == pytest.approx(abs(few[r.vec_id, r.component].whitened), abs=1e-9)


def test_odd_rows_are_left_out(spark):
    data = vectors(50, 6)
    odd = [(100, None), (101, [1.0, None, 2, 3, 4, 5]), (102, [math.nan] * 6), (103, [math.inf] + [0] * 5), (104, []), (105, [1.0, 2.0]), (106, [3e38] * 6)]
    got = whitening.whitening(table(spark, [*enumerate(data.tolist()), *odd])).collect()
    check(got, list(range(50)), data, 6)


def test_repeated_and_null_ids_are_vectors_of_their_own(spark):
    data = vectors(40, 4)
    got = whitening.whitening(table(spark, [(None if i % 2 else 7, v) for i, v in enumerate(data.tolist())])).collect()
    assert len(got) == 160 and {r.vec_id for r in got} == {None, 7} and {r.n for r in got} == {40}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whitening(table(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert got.collect() == []


def test_dimensions_without_variance_have_no_component(spark):
    data = vectors(60, 5)
    data[:, 2:] = 1.5
    got = whitening.whitening(table(spark, list(enumerate(data.tolist())))).collect()
    check(got, list(range(60)), data, 2)


def test_deviations_beyond_a_long(spark):
    data = np.array([[1e12, 0.0], [-1e12, 5.0], [3.0, 1.0]], np.float32)
    model = whitening.fit(table(spark, list(enumerate(data.tolist()))))
    got = {(r.vec_id, r.component): r.deviation for r in whitening.transform(table(spark, list(enumerate(data.tolist()))), model).collect()}
    assert [int(got[i, 1]) for i in range(3)] == brute(data, 1)[2]
    assert {r.deviation for r in whitening.whitening(table(spark, list(enumerate(data.tolist())))).collect() if r.vec_id < 2} == {None}
