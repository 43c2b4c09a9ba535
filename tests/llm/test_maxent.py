from collections import Counter
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import prose
from pairloom.llm import maxent


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    counts = Counter()
    for i, text in rows:
        if held(i) is False:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        seen = [counts[t] for t in tokens(text)]
        score = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in seen)
        out.append((i, held(i), len(seen), sum(c > 0 for c in seen), total, score))
    return out


@pytest.fixture(scope="module")
def corpus():
    return [(i, prose(i, 80)) for i in range(120)]


@pytest.mark.parametrize("head", [maxent.HEAD, 30])
def test_base_equals_brute_force(spark, documents, odd_rows, corpus, head):
    """With a small head most counts come by the join."""
    rows = [r for r in odd_rows if r[0] not in (5, 6, 7)] + [(100 + i, t) for i, t in corpus]
    got = sorted(maxent.language_scores(documents(rows), head=head).collect(), key=lambda r: repr(r.doc_id))
    want = sorted(base(rows), key=lambda r: repr(r[0]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)
    assert all(r.score <= 0 for r in got)


def test_head_does_not_change_counts_of_classes(spark, documents, corpus):
    """The class of all other words takes what the head leaves."""
    words = np.arange(1, 11, dtype=np.uint64)
    n = np.arange(10, 0, -1)
    v = maxent.Vocabulary(words[:6], n[:6], np.ones((6, maxent.SIGNS)), int(n.sum()), 10)
    assert 10 ** v.log_class[maxent.REST] == pytest.approx(n[6:].sum() + 0.1 * 5)


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(0)
    words, n = np.arange(5, 505, dtype=np.uint64) * np.uint64(977), rng.integers(1, 50, 500)
    v = maxent.Vocabulary(words, n, rng.normal(size=(500, maxent.SIGNS)), int(n.sum()), 500)
    table = rng.normal(size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    z = maxent.class_scores(table, maxent.contexts(words[:3], np.array([3])))
    assert np.allclose(np.exp(z).sum(1), 1, atol=1e-5)
    inside = (np.r_[v.n, 0] + maxent.SMOOTH) / 10 ** v.log_class[np.r_[v.kind, maxent.REST]]
    assert np.bincount(np.r_[v.kind, maxent.REST], inside, maxent.CLASSES)[np.unique(np.r_[v.kind, maxent.REST])] == pytest.approx(1.0)


def test_the_table_grows_with_the_training_tokens():
    assert [maxent.doublings(n) for n in (0, 1, 1 << 25, 1 << 27, 1 << 29, 1 << 33, 1 << 45)] == [0, 0, 0, 1, 2, 4, 4]
    tokens = np.random.default_rng(4).integers(0, 1 << 63, 5000).astype(np.uint64)
    small, large = (maxent.contexts(tokens, np.array([5000]), maxent.BUCKETS << n) for n in (0, 4))
    assert (large % maxent.BUCKETS == small).all() and large.max() >= maxent.BUCKETS << 3
    bucket = large[:, 2]
    assert (maxent._stable_order(bucket) == np.argsort(bucket, kind="stable")).all()


def test_larger_tables_learn_and_do_not_follow_the_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(maxent, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(maxent, "GROUP_TOKENS", 500)
    rows = [(i, prose(i, 60) if i % 2 else " ".join(w[::-1] + "x" for w in prose(i, 60).split())) for i in range(500)]
    assert maxent.doublings(25_000) == 3
    found = [{r.doc_id: r for r in maxent.language_scores(documents(rows).repartition(n)).collect()} for n in (1, 5)]
    assert {i: r.score for i, r in found[0].items()} == pytest.approx({i: r.score for i, r in found[1].items()}, abs=1e-6)
    assert sum(r.score for r in found[0].values()) > sum(r.base_score + 0.1 * r.n_tokens for r in found[0].values())


def test_places_equal_a_binary_search():
    rng = np.random.default_rng(2)
    words = np.unique(np.r_[rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1)])
    v = maxent.Vocabulary(words, np.ones(len(words), int), np.zeros((len(words), maxent.SIGNS)), len(words), len(words))
    for words_in_head in (words, words[:-1], words[100:101]):
        v = maxent.Vocabulary(words_in_head, np.ones(len(words_in_head), int), np.zeros((len(words_in_head), maxent.SIGNS)), len(words), len(words))
        asked = np.r_[words, words + np.uint64(1), np.uint64(0), np.uint64(2**64 - 1)]
        at, known = v.place(asked)
        assert (known == np.isin(asked, words_in_head)).all()
        assert (v.words[at[known]] == asked[known]).all()


def test_a_step_equals_the_plain_sums():
    """One step against sums taken row by row, with weights far apart too."""
    rng = np.random.default_rng(3)
    for scale in (1.0, 60.0):
        table = rng.normal(scale=scale, size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
        features = np.stack([np.zeros(900, int), *(rng.integers(0, top, 900) for top in (9, 700, maxent.BUCKETS))], 1).astype(np.int32)
        kind = rng.integers(0, maxent.CLASSES, 900)
        z = sum(table[features[:, i]].astype(float) for i in range(4))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        chosen = np.log(np.maximum(p[np.arange(900), kind], 1e-300))
        assert np.allclose(maxent.chosen_scores(table, features, kind), chosen, rtol=1e-4, atol=1e-3)
        p[np.arange(900), kind] -= 1
        want, seen = table.astype(float), np.zeros(table.shape)
        for i in range(4):
            total = np.zeros(table.shape)
            np.add.at(total, features[:, i], p)
            seen += total * total
            want -= maxent.RATE * total / np.sqrt(seen + 1.0)
        got = table.copy()
        maxent.gradient_steps(got, np.zeros_like(got), features, kind)
        assert np.allclose(got, want, atol=1e-4 * scale)


def test_gradient_steps_learn_the_classes():
    rng = np.random.default_rng(1)
    features = rng.integers(0, 50, (20_000, 4)).astype(np.int32)
    kind = features[:, 1] % 5
    table, seen = np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32), np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32)
    before = -maxent.class_scores(table, features)[np.arange(len(kind)), kind].mean()
    for _ in range(4):
        maxent.gradient_steps(table, seen, features, kind)
    after = -maxent.class_scores(table, features)[np.arange(len(kind)), kind].mean()
    assert after < 0.5 * before


def test_contexts_stay_inside_a_text():
    a = maxent.contexts(*maxent.tokens_of(pa.array(["x y z", "x y"])))
    b = maxent.contexts(*maxent.tokens_of(pa.array(["x y"])))
    assert (a[4:] == b).all() and (a[4:6] == a[:2]).all()


def test_beats_the_base_on_held_out_texts(spark, documents):
    """Two vocabularies that do not mix: the class of the next word follows from the words before."""
    rows = [(i, prose(i, 60) if i % 2 else " ".join(w[::-1] + "x" for w in prose(i, 60).split())) for i in range(600)]
    got = maxent.language_scores(documents(rows)).where("held_out").collect()
    assert len(got) > 30
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.15 * sum(r.n_tokens for r in got)


def test_empty_table(spark, documents):
    assert maxent.language_scores(documents([])).count() == 0


def test_the_layout_of_the_table_changes_no_score(spark, documents, monkeypatch):
    monkeypatch.setattr(maxent, "GROUP_TOKENS", 3000)
    monkeypatch.setattr(maxent, "PORTION", 4000)
    rows = [(i, prose(i % 150, 20 + i % 90)) for i in range(400)]
    found = []
    for parts in (1, 2, 7):
        scored = maxent.language_scores(documents(rows).repartition(parts)).select("doc_id", "score").collect()
        found.append({r.doc_id: r.score for r in scored})
    assert len(set(found[0].values())) > 100
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=1e-6)


def test_portions_do_not_follow_the_batches(monkeypatch):
    monkeypatch.setattr(maxent, "PORTION", 25)
    rows = [(g, "x" * (7 * i % 19) if i % 5 else None) for g in (0, 2, 3) for i in range(20)]
    want = None
    for size in (1, 3, 60):
        batches = [pa.record_batch([pa.array([g for g, _ in rows[i : i + size]], pa.int32()), pa.array([t for _, t in rows[i : i + size]], pa.string())], ["group", "text"]) for i in range(0, 60, size)]
        got = [(g, t.to_pylist()) for g, t in maxent._portions(iter(batches))]
        assert [(g, t) for g, texts in got for t in texts] == rows
        want = want or got
        assert got == want
