"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Texts are compared in lower case with every run of other characters than
letters and digits as one blank. The windows of an item start at every place; a
window of m characters within e edits of a place in a document shares at least
``m - q + 1 - q * e`` of its q-grams with it, on diagonals that span at most e.
Items are indexed by the places of their q-grams. Shared places are put in
overlapping diagonal bands of twice that width; the windows that hold enough
places of a band are kept, and a banded alignment decides.

Documents are never shuffled. The items are a broadcast index of bounded
size; a larger benchmark is searched in blocks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.frames import id_and_text, mapped, tuned
from pairloom.llm.words import column_bytes

Q = 10  # eight bytes and two, see gram_hashes
# At stride 1 any part of an item of 80 compared characters is a window.
WINDOW, STRIDE = 80, 1
EDIT_RATE = 0.08
MIN_CHARS = 25
BLOCK_BYTES = 1 << 20
# A q-gram at more places than this is left out where the others can still meet the bound.
FREQUENT = 64
STEP = 1 << 17
AT_ONCE = 2048

_BLANK = 32
_FOLD = np.full(256, _BLANK, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compared form of the bytes, and which bytes it keeps."""
    fold = _FOLD[raw]
    keep = fold != _BLANK
    keep[1:] |= keep[:-1] & (fold[1:] == _BLANK)
    return fold[keep], keep


def gram_hashes(text: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hashes of the q-grams that start at first .. last - 1."""
    n = last - first
    low = np.ndarray((n,), "<u8", text.data, first, (1,))
    high = np.ndarray((n,), "<u2", text.data, first + 8, (1,)).astype(np.uint64)
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The q-gram index of some items, and their windows."""

    def __init__(self, items: list[tuple[int, str]], window: int, stride: int, edit_rate: float) -> None:
        texts, ids = [], []
        for item_id, text in items:
            text = folded(np.frombuffer((text or "").encode(), np.uint8).copy())[0]
            text = np.frombuffer(text.tobytes().strip(), np.uint8)
            if len(text) >= MIN_CHARS:
                texts.append(text)
                ids.append(item_id)
        ids = np.array(ids, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.first_char = np.r_[0, np.cumsum(size)]
        self.length = np.minimum(size, window)
        # No more edits than leave a q-gram that must be shared.
        self.limit = np.minimum(np.floor(self.length * edit_rate), (self.length - Q) // Q).astype(np.int64)
        cuts = [np.append(np.arange(0, n - m, stride), n - m) for n, m in zip(size.tolist(), self.length.tolist())]
        # Windows of one item are neighbours, in order of their places.
        self.first_window = np.r_[0, np.cumsum([len(c) for c in cuts])].astype(np.int64)
        self.start = np.concatenate(cuts).astype(np.int32) if cuts else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first_window))
        self.item, self.edits = ids[self.owner], self.limit[self.owner]

        places = size - Q + 1
        first = np.r_[0, np.cumsum(places)]
        grams = np.concatenate([gram_hashes(t, 0, n) for t, n in zip(texts, places)]) if texts else np.zeros(0, np.uint64)
        begin = first[self.owner] + self.start
        end = begin + self.length[self.owner] - Q + 1
        within = lambda marked: (total := np.r_[0, np.cumsum(marked)])[end] - total[begin]
        _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        rare = count[inverse] <= FREQUENT
        # A window that could not meet its bound without the frequent ones keeps them.
        need_all = within(rare) - Q * self.edits < Q
        change = np.bincount(begin[need_all], minlength=len(grams) + 1) - np.bincount(end[need_all], minlength=len(grams) + 1)
        use = rare | (np.cumsum(change)[: len(grams)] > 0)
        self.bound = np.maximum(1, within(use) - Q * self.edits).astype(np.int32)
        self.least = np.minimum.reduceat(self.bound, self.first_window[:-1]) if texts else self.bound
        of = np.repeat(np.arange(len(texts)), places)[use]
        place = _within(places)[use]
        grams = grams[use]
        order = np.argsort(grams, kind="stable")
        self.gram_item, self.gram_place = of[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(order))
        bits = min(24, max(16, int(len(self.grams) * 64).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.grams >> self.shift).astype(np.int64)] = True

    @property
    def texts(self) -> list[bytes]:
        at = self.first_char[self.owner] + self.start
        return [self.text[a : a + m].tobytes() for a, m in zip(at.tolist(), self.length[self.owner].tolist())]

    def hits(self, text: np.ndarray):
        """(place in the text, number of the item, place in the item) of every shared q-gram."""
        out = []
        for at in range(0, len(text) - Q + 1, STEP):
            h = gram_hashes(text, at, min(at + STEP, len(text) - Q + 1))
            near = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
            if not len(near):
                continue
            h = h[near]
            k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            true = self.grams[k] == h
            near, k = near[true] + at, k[true]
            times = self.first[k + 1] - self.first[k]
            entry = np.repeat(self.first[k], times) + _within(times)
            out.append((np.repeat(near, times), self.gram_item[entry], self.gram_place[entry]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def _within(times: np.ndarray) -> np.ndarray:
    """0 .. t - 1 for every t."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)


def banded_distances(windows: np.ndarray, text: np.ndarray, at: np.ndarray, diagonals: int, limit: int):
    """(row, edits, begin, end) of the windows (rows of equal length) that some part of ``text`` equals within ``limit`` edits.

    Row i is compared along the diagonals that start at ``at[i]`` and the places
    after it. A cell is the number of edits times the number of diagonals, plus
    the diagonal where it began.
    """
    near = np.lib.stride_tricks.sliding_window_view(text, diagonals)
    d = np.arange(diagonals, dtype=np.int32)
    step = d * diagonals
    rows = np.arange(len(windows))
    cells = np.tile(d, (len(windows), 1))
    for i in range(windows.shape[1]):
        new = cells + (near[at + i] != windows[:, i : i + 1]) * np.int32(diagonals)
        np.minimum(new[:, :-1], cells[:, 1:] + np.int32(diagonals), out=new[:, :-1])
        cells = np.minimum.accumulate(new - step, axis=1) + step
        if i % 8 == 7:
            live = cells.min(1) < (limit + 1) * diagonals
            if not live.all():
                rows, windows, at, cells = rows[live], windows[live], at[live], cells[live]
                if not len(rows):
                    break
    last = cells.argmin(1) if len(rows) else rows
    best = cells[np.arange(len(rows)), last]
    met = best < (limit + 1) * diagonals
    rows, at, last, best = rows[met], at[met], last[met], best[met]
    return rows, best // diagonals, at + best % diagonals, at + last + windows.shape[1]


def _aligned(index: Windows, item: int, places: np.ndarray, diagonal: int, low: int, fold: np.ndarray):
    """(window, edits, begin, end) of the windows of an item that a text has in the band from ``low``; one shared diagonal is tried first."""
    m, e = int(index.length[item]), int(index.limit[item])
    first, last = index.first_window[item : item + 2].tolist()
    start = index.start[first:last]
    first, last = first + int(np.searchsorted(start, places[0] - (m - Q))), first + int(np.searchsorted(start, places[-1], "right"))
    start = index.start[first:last].astype(np.int64)
    held = np.searchsorted(places, start + m - Q, "right") - np.searchsorted(places, start)
    enough = held >= index.bound[first:last]
    window, start = np.flatnonzero(enough) + first, start[enough]
    if not len(window):
        return
    # What is equal on the diagonal needs no alignment.
    char = index.first_char[item]
    chars = index.text[char + start[0] : char + start[-1] + m]
    there = np.arange(len(chars)) + int(start[0]) + diagonal
    inside = (there >= 0) & (there < len(fold))
    same = inside & (fold[np.clip(there, 0, len(fold) - 1)] == chars)
    total = np.r_[0, np.cumsum(same)]
    equal = total[start - start[0] + m] - total[start - start[0]] == m
    for w, at in zip(window[equal].tolist(), (start[equal] + diagonal).tolist()):
        yield w, 0, at, at + m
    window, start = window[~equal], start[~equal]
    diagonals = 4 * e + 2
    for part in range(0, len(window), AT_ONCE):
        ws, at = window[part : part + AT_ONCE], start[part : part + AT_ONCE]
        # Zeros, which no text holds, before and after the text.
        begin = int(at[0]) + low - e
        region = np.zeros(int(at[-1] - at[0]) + m + diagonals, np.uint8)
        a, b = max(0, begin), min(len(fold), begin + len(region))
        if a >= b:
            continue
        region[a - begin : b - begin] = fold[a:b]
        pieces = index.text[(char + at)[:, None] + np.arange(m)]
        for row, edits, x, y in zip(*(v.tolist() for v in banded_distances(pieces, region, at - at[0], diagonals, e))):
            x, y = max(0, x + begin), min(len(fold), y + begin)
            if x < y:
                yield int(ws[row]), edits, x, y


def find_windows(index: Windows, raw: np.ndarray, offsets: np.ndarray):
    """Rows (text number, window, edits, first byte, last byte + 1) of all texts of a batch."""
    first, last = int(offsets[0]), int(offsets[-1])
    fold, keep = folded(raw[first:last])
    # Place of each text in the compared form; the kept bytes before it.
    chunk = np.add.reduceat(np.append(keep, False), np.minimum(offsets[:-1] - first, len(keep)), dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
    chunk = np.where(np.diff(offsets) > 0, chunk, 0)
    starts = np.r_[0, np.cumsum(chunk)]
    found = []
    if len(fold) < Q or not len(index.grams):
        return found
    at, item, place = index.hits(fold)
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + Q <= starts[text + 1]
    at, item, place, text = at[inside], item[inside], place[inside], text[inside]
    # First by text and item alone, then by band.
    pair = text * len(index.length) + item
    _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = count[inverse] >= index.least[item]
    at, item, place, text = at[enough], item[enough], place[enough], text[enough]
    if not len(at):
        return found
    diagonal = at - place - starts[text]
    band = diagonal // (index.limit[item] + 1)
    n = len(at)
    text, item, place, diagonal, band = (np.concatenate([v, v]) for v in (text, item, place, diagonal, band))
    band[n:] -= 1
    upper = np.arange(2 * n) >= n
    order = np.lexsort((place, band, item, text))
    text, item, place, diagonal, band, upper = (v[order] for v in (text, item, place, diagonal, band, upper))
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
    cuts = np.flatnonzero(new)
    ends = np.append(cuts[1:], 2 * n)
    # A band without places in its upper half holds nothing that the band before lacks.
    enough = np.logical_or.reduceat(upper, cuts) & (ends - cuts >= index.least[item[cuts]])
    done: set[tuple[int, int, int]] = set()
    kept_of, kept = -1, None
    for a, b in zip(cuts[enough].tolist(), ends[enough].tolist()):
        t, k = int(text[a]), int(item[a])
        places = place[a:b][np.r_[True, place[a + 1 : b] != place[a : b - 1]]]
        need = int(index.least[k])
        if len(places) < need or (places[need - 1 :] - places[: len(places) - need + 1]).min() > index.length[k] - Q:
            continue
        values, times = np.unique(diagonal[a:b], return_counts=True)
        low = int(band[a]) * (int(index.limit[k]) + 1)
        for w, edits, begin, end in _aligned(index, k, places, int(values[times.argmax()]), low, fold[starts[t] : starts[t + 1]]):
            if (t, w, end) in done:
                continue
            done.add((t, w, end))
            if t != kept_of:
                kept_of, kept = t, np.flatnonzero(keep[offsets[t] - first : offsets[t + 1] - first])
            found.append((t, w, edits, int(kept[begin]), int(kept[end - 1]) + 1))
    return found


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    stride: int = STRIDE,
    edit_rate: float = EDIT_RATE,
) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, first_byte, end_byte): items of which a document has a passage.

    A row for each document row and item with at least one window within the
    edit budget; ``edits`` is the least of any window, the bytes span all of
    them. Items of fewer than ``MIN_CHARS`` compared characters are too common
    to tell and not searched; null and empty texts match nothing, and rows
    with a null id are left out. Equal items match alike.
    """
    spark = tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, n_windows long, edits long, first_byte long, end_byte long"
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, window, stride, edit_rate):
        shared = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared):
            ids = batch.column(0).to_numpy()
            best: dict[tuple[int, int], list[int]] = {}
            for t, w, edits, begin, end in find_windows(shared.value, *column_bytes(batch.column(1))):
                item = int(shared.value.item[w])
                row = best.setdefault((t, item), [0, edits, begin, end])
                row[:] = row[0] + 1, min(row[1], edits), min(row[2], begin), max(row[3], end)
            if not best:
                return None
            values = np.array([[ids[t], item, *row] for (t, item), row in best.items()], np.int64)
            return dict(zip(("doc_id", "item_id", "n_windows", "edits", "first_byte", "end_byte"), values.T.copy()))

        found = mapped(docs, schema, run)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, stride: int, edit_rate: float) -> Iterator[Windows]:
    """The items in blocks of bounded size, at least one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Windows([tuple(r) for r in rows], window, stride, edit_rate)


def without_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    stride: int = STRIDE,
    edit_rate: float = EDIT_RATE,
) -> DataFrame:
    """The rows with a passage of none of the items, all columns as they are. Nothing is shuffled."""
    spark = tuned(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col, window, stride, edit_rate):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row in find_windows(shared.value, *column_bytes(batch.column(at))):
                    clean[row[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
