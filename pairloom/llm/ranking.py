"""Ranked lexical search the other way round: documents stream past an index of the items.

The items (queries) are few next to the documents. Their terms form an inverted
index, term to items with repeats, that every task gets whole. A first pass
turns each document into its number of terms and the counts of those terms
that any item has; it is stored, as document frequencies are needed before any
score. The second pass streams these rows through the index and keeps, per
task and item, a bounded heap of the best documents. Heaps are merged in two
levels by (item, part of the tasks) and by item.

Items are indexed in blocks of bounded bytes, a pass over the documents for
each block: the index never grows with the table of items.

Rows: a null or empty text has no term, counts for nothing and is never ranked.
Each row is a document of its own, repeated ones too; rows with a null id come
last among equals. An item without terms has no rows; rows that share an
item_id are ranked separately.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.frames import id_and_text, int_lists, mapped, tuned
from pairloom.llm.words import ALPHANUMERIC, column_bytes, word_hashes
from pairloom.session import stored

BEST = 20
# Text of the items indexed at once; their index takes about eight times as much.
BLOCK_BYTES = 8 << 20
# Cells of a score table, and (document, item) pairs scored at once in a task.
CELLS = PAIRS = 1 << 21
MERGE_PARTS = 64
NO_ID = np.iinfo(np.int64).max

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"
HEAP_ROWS = "item int, item_id long, part int, doc_id long, score long"


class Index:
    """Term to items, from the texts of one block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = ids
        data, offsets = column_bytes(pa.array(texts, pa.string()))
        hashes, counts = word_hashes(data, offsets, ALPHANUMERIC)
        self.terms, term = np.unique(hashes, return_inverse=True)
        item = np.repeat(np.arange(len(ids)), counts)
        pairs, self.repeats = np.unique(term * len(ids) + item, return_counts=True)
        self.items = pairs % max(1, len(ids))
        self.first = np.searchsorted(pairs, np.arange(len(self.terms) + 1) * len(ids))
        self.longest = int(counts.max(initial=0))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those that no item has."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of all items, each of about ``limit`` bytes of text. Holds one block on the driver."""
    ids, texts, held = [], [], 0
    for row in items.where("text IS NOT NULL AND text <> ''").toLocalIterator():
        ids.append(row["doc_id"])
        texts.append(row["text"])
        held += len(row["text"].encode())
        if held >= limit:
            yield Index(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Index(ids, texts)


def term_counts(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each document counted, those of the index one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> dict:
        index = shared.value
        data, offsets = column_bytes(batch.column(1))
        hashes, n = word_hashes(data, offsets, ALPHANUMERIC)
        number = index.numbers(hashes)
        row = np.repeat(np.arange(len(n)), n)
        known = number >= 0
        width = max(1, len(index.terms))
        keys, counts = np.unique(row[known] * width + number[known], return_counts=True)
        per_row = np.bincount(keys // width, minlength=len(n))
        filled = n > 0
        return {
            "doc_id": batch.column(0).filter(pa.array(filled)),
            "n": n[filled],
            "terms": int_lists(keys % width, per_row[filled], pa.int32()),
            "counts": int_lists(counts, per_row[filled], pa.int32()),
        }

    return mapped(docs, COUNTS, run)


def statistics(counted: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the index."""
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "docs"])

    size = len(index.terms)
    frequency = np.zeros(size, np.int64)
    # As many rows as the index has terms.
    for row in counted.select("terms").mapInArrow(per_task, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        frequency[row["term"]] = row["docs"]
    return total["docs"], total["terms"], frequency


def term_weights(docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * frequency + 1))).astype(np.int64)


def length_terms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The part of the denominator that depends on the length of a document."""
    if 25 * int(n.max(initial=0)) * docs >= 1 << 62:
        n = n.astype(object)
    return (75 + (25 * n * docs) // terms).astype(np.int64)


class Heaps:
    """The best documents of every item seen so far: highest score first, then lowest id."""

    def __init__(self, items: int, best: int) -> None:
        self.best = best
        self.floor = np.ones(items, np.int64)  # least score that can still enter
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        enters = score >= self.floor[item]
        if enters.any():
            self.waiting.append((item[enters], doc[enters], score[enters]))
            self.held += int(enters.sum())
            if self.held > max(PAIRS // 8, len(self.item)):
                self.settle()

    def settle(self) -> None:
        item, doc, score = (np.concatenate(c) for c in zip((self.item, self.doc, self.score), *self.waiting))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.best
        self.item, self.doc, self.score = item[keep], doc[order][keep], score[order][keep]
        last = place[keep] == self.best - 1
        self.floor[self.item[last]] = self.score[last]
        self.waiting, self.held = [], 0


def _scored(index: Index, weights: np.ndarray, exact: bool, d: np.ndarray, n_docs: int, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of some documents for all items, as a table."""
    value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[d]))
    width = index.first[term + 1] - index.first[term]
    ends = np.cumsum(width)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.first[term] - (ends - width), width)
    cell = np.repeat(d, width) * len(index.ids) + index.items[at]
    value = np.repeat(value, width) * index.repeats[at]
    if exact:  # sums below 2^53 are exact in doubles
        return np.bincount(cell, value, n_docs * len(index.ids)).astype(np.int64)
    out = np.zeros(n_docs * len(index.ids), np.int64)
    np.add.at(out, cell, value)
    return out


def heap_rows(counted: DataFrame, index: Index, weights: np.ndarray, docs: int, terms: int, best: int = BEST) -> DataFrame:
    """The heaps of every task: at most ``best`` rows for each item."""
    shared = counted.sparkSession.sparkContext.broadcast((index, weights))
    exact = int(weights.max(initial=0)) * 1_000_000 * index.longest < 1 << 52

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps = Heaps(len(index.ids), best)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            m = length_terms(batch.column(1).to_numpy(), docs, terms)
            lengths = batch.column(2).value_lengths().to_numpy()
            term = batch.column(2).flatten().to_numpy().astype(np.int64)
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            first = np.r_[0, np.cumsum(lengths)]
            work = np.r_[0, np.cumsum(index.first[term + 1] - index.first[term])][first]
            at = 0
            while at < len(ids):
                stop = int(np.searchsorted(work, work[at] + PAIRS, "right")) - 1
                stop = min(max(at + 1, stop), at + max(1, CELLS // len(index.ids)), len(ids))
                part = slice(first[at], first[stop])
                d = np.repeat(np.arange(stop - at), lengths[at:stop])
                score = _scored(index, weights, exact, d, stop - at, term[part], tf[part], m[at:stop])
                cell = np.flatnonzero(score)
                heaps.offer(cell % len(index.ids), ids[at + cell // len(index.ids)], score[cell])
                at = stop
        heaps.settle()
        names = np.array([-1 if i is None else i for i in index.ids], np.int64)
        lost = np.array([i is None for i in index.ids])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(heaps.item.astype(np.int32)),
                pa.array(names[heaps.item], mask=lost[heaps.item]),
                pa.array(np.full(len(heaps.item), TaskContext.get().partitionId() % MERGE_PARTS, np.int32)),
                pa.array(heaps.doc, mask=heaps.doc == NO_ID),
                pa.array(heaps.score),
            ],
            ["item", "item_id", "part", "doc_id", "score"],
        )

    return counted.mapInArrow(run, HEAP_ROWS)


def merged(heaps: DataFrame, best: int = BEST) -> DataFrame:
    """One ranking for each item from the heaps of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    by_part = Window.partitionBy("item", "part").orderBy(*order)
    by_item = Window.partitionBy("item").orderBy(*order)
    some = heaps.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    best: int = BEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``best`` documents of each item: (item_id, rank, doc_id, score), scores above 0 only."""
    tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    out = []
    for index in item_blocks(id_and_text(items, item_col, text_col), block_bytes):
        counted = stored(term_counts(docs, index), "term-counts")
        n_docs, n_terms, frequency = statistics(counted, index)
        weights = term_weights(n_docs, frequency)
        out.append(merged(heap_rows(counted, index, weights, n_docs, n_terms, best), best))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


def oracle_sql(best: int = BEST) -> str:
    """The same in DuckDB over `documents` and `benchmark`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
size AS (SELECT r, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
m AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM size, total),
it AS (SELECT row_number() OVER () AS i, item_id, {terms} AS t FROM benchmark WHERE text IS NOT NULL),
want AS (SELECT i, item_id, term, count(*) AS reps FROM (SELECT i, item_id, unnest(t) AS term FROM it) GROUP BY ALL),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM want) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, total GROUP BY term),
scored AS (SELECT i, item_id, tf.r, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM want JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {best}"""
