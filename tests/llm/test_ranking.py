from collections import Counter
import math
import re

import pytest

from conftest import prose
from pairloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS rank", "'x' AS part", "2L AS score")


ITEMS = [(1, prose(1, 6) + " " + prose(1, 3)), (2, prose(2, 30)), (3, None), (4, "..."), (5, "ZEBRA bada Ünï ünï"), (6, ""), (None, prose(9, 4))]
DOCS = [(i, prose(i, 3 + 7 * i % 90)) for i in range(100, 300)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
@pytest.mark.parametrize("best", [20, 3])
def test_equals_brute_force(spark, documents, odd_rows, block_bytes, best):
    rows = [*DOCS, *odd_rows, (10, "zebra, Zebra; ünï"), (11, "Ünï bada"), (None, prose(1, 6))]
    got = ranking.ranked(documents(rows).repartition(5), items_table(spark, ITEMS), best=best, block_bytes=block_bytes)
    assert rows_of(got) == brute(rows, ITEMS, best)


def test_ties_go_to_the_lowest_ids_whatever_the_layout(spark, documents):
    rows = [(i, "same words in all of these") for i in range(60)] + [(100 + i, prose(i, 20)) for i in range(200)]
    want = brute(rows, [(1, "same words")], 20)
    assert sorted(r[2] for r in want) == list(range(20))
    for parts in (1, 7, 30):
        assert rows_of(ranking.ranked(documents(rows).repartition(parts), items_table(spark, [(1, "same words")]))) == want


def test_scores_beyond_doubles_are_summed_as_integers(spark, documents, monkeypatch):
    rows = DOCS[:30]
    monkeypatch.setattr(ranking, "PAIRS", 64)
    index = ranking.Index([1], [" ".join(["bada"] * 100_000)])
    counted = ranking.term_counts(documents(rows).select("doc_id", "text"), index)
    n_docs, n_terms, frequency = ranking.statistics(counted, index)
    weights = ranking.term_weights(n_docs, frequency) * 1000
    got = ranking.merged(ranking.heap_rows(counted, index, weights, n_docs, n_terms), 20).collect()
    holding = [r for r in rows if "bada" in terms(r[1])]
    assert len(got) == min(20, len(holding))
    assert all(r.score % 100_000 == 0 for r in got)


def test_empty_tables(spark, documents):
    assert rows_of(ranking.ranked(documents([]), items_table(spark, ITEMS))) == []
    assert rows_of(ranking.ranked(documents(DOCS), items_table(spark, []))) == []
