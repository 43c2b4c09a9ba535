import numpy as np
import pytest

from pyspark.sql import functions as F

from conftest import SF, prose
from pairloom.llm import mixing
from pairloom.llm.frames import table
from pairloom.session import stored


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rows = [(i, prose(i, 20 + i % 7) + (" %%%" if i % 5 == 0 else "")) for i in range(300)]
    return documents(rows)


def test_margins_meet_the_targets(spark, corpus):
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.19, "unknown": 0.01}}
    got = mixing.mixing_probabilities(corpus, targets=targets, power=1.0, keep=0.2).toPandas()
    got["expected"] = got.probability * got.n_tokens
    share = got.groupby("source").expected.sum() / got.expected.sum()
    for level, want in targets["source"].items():
        assert share[level] == pytest.approx(want, rel=1e-3)
    assert got.expected.sum() == pytest.approx(0.2 * got.n_tokens.sum(), rel=0.02)
    assert abs((got.kept * got.n_tokens).sum() / got.n_tokens.sum() - 0.2) < 0.08


def bounded(weights, most, rows, targets, rounds=4000):
    """Bounded raking in NumPy: each factor found by bisection."""
    y = weights.copy()
    for _ in range(rounds):
        for levels, target in zip(rows, targets):
            for level, want in target.items():
                at = levels == level
                low, high = 0.0, 1e6
                for _ in range(80):
                    middle = (low + high) / 2
                    low, high = (middle, high) if np.minimum(most[at], middle * y[at]).sum() < want else (low, middle)
                y[at] *= low
        if max(abs(np.minimum(most, y)[lv == k].sum() - w) for lv, t in zip(rows, targets) for k, w in t.items()) < 1e-10:
            break
    return np.minimum(most, y)


def reachable(raw, most):
    """Shares in the ratio of ``raw`` that sum to one, none above ``most``."""
    full = set()
    while True:
        rest = sum(raw[k] for k in raw if k not in full)
        scale = (1 - sum(most[k] for k in full)) / rest if rest else 0
        new = {k for k in raw if k not in full and scale * raw[k] > most[k]}
        if not new:
            return {k: most[k] if k in full else scale * raw[k] for k in raw}
        full |= new


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.8])
def test_raking_equals_numpy(spark, corpus, keep):
    got = mixing.mixing_probabilities(corpus, keep=keep).toPandas()
    cells = got.groupby(["source", "lang", "topic"]).agg(w=("n_tokens", "sum"), p=("probability", "first")).reset_index()
    share = cells.w.to_numpy(float) / cells.w.sum()
    rows = [cells[d].to_numpy() for d in mixing.DIMENSIONS]
    targets = []
    for levels in rows:
        has = {k: share[levels == k].sum() for k in set(levels)}
        targets.append(reachable({k: v**0.5 for k, v in has.items()}, {k: v / keep for k, v in has.items()}))
    want = bounded(share, share / keep, rows, targets)
    assert np.allclose(keep * want / share, cells.p, atol=1e-6)


def test_margins_hold_where_they_can(spark):
    """Whole tables at the default part to keep: reachable margins and the total within one in a hundred."""
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    names = [c.alias(n) for n, c in mixing._dimensions("doc_id", "text", "source", "lang", None).items()]
    cells = stored(docs.select(*names).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    found = mixing.margins(mixing.raked_cells(cells)).collect()
    assert {r.dimension for r in found} == set(mixing.DIMENSIONS)
    for r in found:
        assert r.expected == pytest.approx(r.reachable, rel=0.01)
        assert r.reachable >= r.wanted * 0.999 or r.expected == pytest.approx(r.reachable, rel=1e-6)
    got = mixing.mixing_probabilities(docs).toPandas()
    assert (got.probability * got.n_tokens).sum() == pytest.approx(mixing.KEEP * got.n_tokens.sum(), rel=0.01)


def test_short_levels_give_all_and_the_others_share_the_rest(spark):
    rows = [("a", "x", "t", 10), ("b", "x", "t", 50), ("c", "x", "t", 40)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}}
    by = {r.level: r for r in mixing.margins(mixing.raked_cells(cells, targets=targets, keep=0.5)).collect() if r.dimension == "source"}
    assert by["a"].wanted == 0.5 and by["a"].reachable == by["a"].expected == pytest.approx(0.2)
    assert by["b"].expected == pytest.approx(0.48) and by["c"].expected == pytest.approx(0.32)


def test_many_cells_are_raked_without_one_task(spark, corpus, monkeypatch):
    want = sorted(mixing.mixing_probabilities(corpus).collect())
    monkeypatch.setattr(mixing, "TOGETHER", 0)
    assert sorted(mixing.mixing_probabilities(corpus).collect()) == want


def test_same_sample_every_time(spark, corpus):
    first = {r.doc_id for r in mixing.mixed(corpus).collect()}
    assert first == {r.doc_id for r in mixing.mixing_probabilities(corpus.repartition(3)).where("kept").collect()}


def test_odd_rows(spark, documents, odd_rows):
    got = mixing.mixing_probabilities(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows) - 1
    assert all(r.probability == 0 and not r.kept for r in got if r.doc_id in (0, 1, 2))
    assert {r.source for r in got if r.doc_id == 4} == {"unknown"}
    kept = mixing.mixed(documents(odd_rows))
    assert kept.columns == documents([]).columns
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixing_probabilities(documents([(0, None)])).first().kept is False
