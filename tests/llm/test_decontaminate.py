import random

import numpy as np
import pytest

from conftest import WORDS, prose
from pairloom.llm import decontaminate as dec


def edited(text, seed, edits):
    rng = random.Random(seed)
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(chars) - 1)
        rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, "q"), lambda: chars.__setitem__(at, "z")])()
    return "".join(chars)


def distance(window, text):
    """The fewest edits between a window and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.fixture(scope="module")
def items():
    return [(i, prose(1000 + i, 12 + 9 * i)) for i in range(6)] + [(6, "short"), (7, None), (8, ""), (None, prose(1, 30)), (9, prose(1001, 21))]


def test_finds_exact_and_edited_passages_and_no_others(spark, documents, items):
    text = dict(items)
    rows = [(100 + i, f"{prose(i, 40 + i)} {text[i]} {prose(50 + i, 30)}") for i in range(6)]
    rows += [(200 + i, f"{prose(i, 9)} {edited(text[i], i, max(1, int(len(text[i]) * 0.03)))}") for i in range(6)]
    rows += [(300, text[5].upper().replace(" ", " ... ")), (301, text[4][20:160]), (302, text[3] + " " + text[3])]
    rows += [(400 + i, prose(700 + i, 300)) for i in range(20)]
    got = {(r.doc_id, r.item_id): r for r in dec.benchmark_matches(documents(rows), benchmark(spark, items)).collect()}
    want = {(b + i, i) for b in (100, 200) for i in range(6)} | {(300, 5), (301, 4), (302, 3)}
    want |= {(d, 9) for d, i in want if i == 1}  # an equal item matches alike
    assert set(got) == want
    assert all(got[100 + i, i].edits == 0 for i in range(6))
    r, raw = got[103, 3], dict(rows)[103].encode()
    assert raw[r.first_byte : r.end_byte].decode().strip() == text[3]
    clean = dec.without_matches(documents(rows), benchmark(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == [400 + i for i in range(20)]


def test_blocks_of_items_give_the_same(spark, documents, items, monkeypatch):
    rows = [(i, f"{prose(i, 20)} {t}") for i, t in items if i is not None]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(dec.benchmark_matches(documents(rows), benchmark(spark, items)))
    monkeypatch.setattr(dec, "BLOCK_BYTES", 300)
    assert key(dec.benchmark_matches(documents(rows), benchmark(spark, items))) == whole


def test_filter_loses_no_window_within_the_budget():
    """Every window within its budget by brute force is found."""
    rng = random.Random(3)
    passage = prose(42, 40)
    index = dec.Windows([(1, passage)], 60, 30, 0.06)
    for seed in range(60):
        text = f"{prose(seed, 6)} {edited(passage, seed, rng.randint(0, 9))} {prose(seed + 1, 5)}".encode()
        raw = np.frombuffer(text, np.uint8)
        found = {row[1] for row in dec.find_windows(index, raw, np.array([0, len(raw)]))}
        fold = dec.folded(raw)[0].tobytes()
        want = {w for w, piece in enumerate(index.texts) if distance(piece, fold) <= index.edits[w]}
        assert found == want


def test_finds_a_copy_of_one_window_at_every_place():
    """Any 80 compared characters of an item are found, exact or with 6 edits."""
    passage = prose(77, 90)[:400].strip()
    index = dec.Windows([(1, prose(78, 60)), (2, passage)], dec.WINDOW, dec.STRIDE, dec.EDIT_RATE)
    places = range(len(passage) - 80 + 1)
    texts = [f"{prose(p, 9)} 7{passage[p : p + 80]}7 {prose(p + 1, 9)}".encode() for p in places]
    texts += [f"{prose(p, 9)} 7{edited(passage[p : p + 80], p, 6)}7 {prose(p + 1, 9)}".encode() for p in places]
    texts += [prose(9000 + i, 60).encode() for i in range(50)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    rows = dec.find_windows(index, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert {t for t, *_ in rows} == set(range(2 * len(places)))
    assert {index.item[w] for _, w, *_ in rows} == {2}
    exact = {t for t, w, edits, *_ in rows if edits == 0 and index.start[w] == t}
    assert exact == set(places)


def test_odd_rows(spark, documents, odd_rows, items):
    assert dec.benchmark_matches(documents(odd_rows), benchmark(spark, items)).count() == 0
    assert dec.benchmark_matches(documents([]), benchmark(spark, items)).count() == 0
    assert dec.benchmark_matches(documents(odd_rows), benchmark(spark, [])).count() == 0
    left = dec.without_matches(documents(odd_rows), benchmark(spark, items))
    assert left.columns == documents([]).columns and left.count() == len(odd_rows)
    assert " ".join(WORDS[:3]) not in dict(odd_rows)[5]
