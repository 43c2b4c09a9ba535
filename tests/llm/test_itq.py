import math

import numpy as np

from pairloom.llm import itq


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, root string, table int, tables string")


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    parent = {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for n, x in enumerate(rows):
        for m, y in enumerate(rows[:n]):
            if x[2] is None or x[2] != y[2] or not usable(x[1]) or not usable(y[1]) or len(x[1]) != len(y[1]):
                continue
            a, b = np.array(x[1], np.float32).astype(float), np.array(y[1], np.float32).astype(float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[n] += 1
                links[m] += 1
                p, q = find(x[0]), find(y[0])
                parent[max(p, q)] = min(p, q)
    return sorted((r[0], n, find(r[0]), r[0] == find(r[0])) for r, n in zip(rows, links))


def made(seed=0, groups=12, size=9, spread=0.18):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=24)
        for _ in range(size):
            v = centre + spread * rng.normal(size=24)
            rows.append((len(rows), v.astype(np.float32).tolist(), g % 3, "r", 1, "t"))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    rows = made()
    want = brute(rows)
    assert 50 < sum(r[1] for r in want) < len(rows) * 8
    assert rows_of(itq.embedding_duplicates(table(spark, rows))) == want


def test_blocks_and_copies(spark):
    rows = made(1, 4, 20)
    rows += [(100 + i, rows[0][1], rows[0][2], "r", 1, "t") for i in range(7)]
    assert rows_of(itq.embedding_duplicates(table(spark, rows), block=4)) == brute(rows)


def test_odd_vectors(spark):
    v = [1.0] * 8
    rows = [
        (0, v, 1), (1, v, None), (2, None, 1), (3, [], 1), (4, [0.0] * 8, 1), (5, [None] + v[1:], 1), (6, [float("nan")] + v[1:], 1),
        (7, [float("inf")] + v[1:], 1), (8, v, 1), (8, v, 1), (None, v, 1), (9, [2.0] * 8, 1), (10, [1.0] * 3, 1), (11, v, 2), (12, [-1.0] * 8, 1),
    ]
    rows = [(*r, "r", 1, "t") for r in rows]
    assert rows_of(itq.embedding_duplicates(table(spark, rows))) == brute(rows)
    assert rows_of(itq.embedding_duplicates(table(spark, []))) == []


def test_recall_at_the_threshold():
    """Pairs at the very threshold meet in some table nearly always."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    for largest in (1000, 100_000, 10_000_000):
        chunk, rotations = itq.plan(largest)
        codes = itq.Codes(list(a[:1500]), rotations, chunk)
        assert (codes.chunks(a) == codes.chunks(b)).any(1).mean() > 0.98


def test_recall_with_a_common_mean_and_many_dimensions():
    """Vectors that share a mean, or have more dimensions than a code has bits, meet as often."""
    rng = np.random.default_rng(4)
    for dim, shared in ((64, 0.5), (64, 0.8), (256, 0.0), (256, 0.5)):
        a = rng.normal(size=(2000, dim))
        a *= math.sqrt(1 - shared) / np.linalg.norm(a, axis=1, keepdims=True)
        a[:, 0] += math.sqrt(shared)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
        for largest in (1000, 100_000):
            sample = list(a[:1500])
            chunk, rotations = itq.plan(largest, angles=itq.threshold_angles(sample))
            codes = itq.Codes(sample, rotations, chunk)
            met = (codes.chunks(a[1500:]) == codes.chunks(b[1500:])).any(1).mean()
            print(dim, shared, largest, chunk, rotations, met)
            assert met > 0.98


def test_all_pairs_where_tables_cost_more(spark):
    rng = np.random.default_rng(6)
    common = 4 * rng.normal(size=24)
    rows = [(i, (common + rng.normal(size=24) * (1 if i % 9 else 6)).astype(np.float32).tolist(), 1, "r", 1, "t") for i in range(120)]
    assert rows_of(itq.embedding_duplicates(table(spark, rows), block=16)) == brute(rows)


def test_rotation_balances_and_loses_less():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)) * np.linspace(3, 0.3, 16)
    x -= x.mean(0)
    loss = lambda p: ((np.sign(x @ p) - x @ p / (x @ p).std()) ** 2).mean()
    main = np.linalg.svd(x, full_matrices=False)[2].T
    learned = itq.learned_rotation(x, 16)
    assert loss(learned) < loss(main)
    assert np.abs((x @ learned > 0).mean(0) - 0.5).max() < 0.1
