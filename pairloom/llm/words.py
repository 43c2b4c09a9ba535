"""Words of many texts at once: NumPy over the bytes of an Arrow string column.

A batch is walked in slices of about 128 kB that end between words, so the
working memory does not depend on the length of a text.
"""

import numpy as np
import pyarrow as pa

SLICE = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Separators are fixed by the definitions of a word: white space, or all ASCII but letters and digits.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[0:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:128] = True

SPACED, ALPHANUMERIC = "spaced", "alphanumeric"


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse; grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 4096)
            self.up, self.down = (self._table(b, size) for b in (_BASE, _INVERSE))
        return self.up, self.down

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS = _Powers()


def _slices(separator: np.ndarray, data: np.ndarray, ends: np.ndarray, first: int, last: int):
    """Cuts of [first, last) after separators or texts, about SLICE bytes apart."""
    at = first
    while at < last:
        stop = min(at + SLICE, last)
        if stop < last:
            text = ends[np.searchsorted(ends, stop, "right") - 1]
            if text > at:
                stop = int(text)
            else:
                found = np.flatnonzero(separator[data[at:stop]])
                if len(found):
                    stop = at + int(found[-1]) + 1
                else:
                    found = np.flatnonzero(separator[data[stop:last]])
                    stop = min(stop + int(found[0]) + 1 if len(found) else last, int(ends[np.searchsorted(ends, stop, "left")]))
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str = SPACED, spans: bool = False):
    """Hashes of the lower-cased words of all texts, and how many words each text has.

    With ``spans`` also where each word starts and ends in ``data``.
    """
    separator = _SPACE if kind == SPACED else _PUNCTUATION
    first, last = int(offsets[0]), int(offsets[-1])
    hashes, begins, stops = [], [], []
    for at, stop in _slices(separator, data, offsets, first, last):
        piece = data[at:stop]
        inside = ~separator[piece]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        # No word goes on from one text to the next.
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        joined = cut[before[cut]]
        before[cut] = False
        start = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        if len(joined):
            ends = np.union1d(ends, joined)
        up, down = _POWERS.get(len(piece))
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[ends] - total[start]) * down[start]))
        begins.append(start + at)
        stops.append(ends + at)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(begins, offsets))
    if spans:
        return hashes, counts, begins, np.concatenate(stops) if stops else np.zeros(0, np.int64)
    return hashes, counts


def hash_of(word: str | bytes) -> int:
    """The hash ``word_hashes`` gives to one word."""
    raw = np.frombuffer(word if isinstance(word, bytes) else word.encode(), np.uint8)
    up, _ = _POWERS.get(len(raw))
    total = ((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)]).sum(dtype=np.uint64)
    return int(mix(np.array([total], np.uint64))[0])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; order matters. Shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def batches_of(column: pa.Array, limit: int = 4 << 20):
    """Row ranges of a batch whose texts have about ``limit`` bytes together."""
    _, offsets = column_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(stop, len(offsets) - 1)
        at = stop
