"""Pre-tokens of the byte-level pattern: a finite-state machine over character classes.

The machine is run over all chunks of a batch at once. Each chunk first gives
its map from entry to exit state, the maps are composed by a parallel prefix
scan, and a second run from the true entry states marks where tokens begin.
"""

from functools import lru_cache
import os

# Spark runs a task on every core already. Has to be set before the library is used.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pairloom.llm.words import column_bytes, mix

CHUNK = 256
PIECE = 1 << 18

# Classes of characters, then symbols of the machine: a class with what a window of the next two characters decides.
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
S_LETTER, S_NUMBER, S_OTHER, S_APOSTROPHE1, S_APOSTROPHE2, S_SPACE, S_LAST_BLANK, S_LAST_SPACE, S_END, S_NONE = range(10)
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, CONTRACTION1, CONTRACTION2 = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]: whether a token begins at the character."""
    step, mark = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHER)):
        step[symbol] = state
        mark[symbol, [state, AFTER_BLANK]] = False
    # The letters of a contraction belong to it; what follows is a new token.
    step[S_LETTER, CONTRACTION1], mark[S_LETTER, CONTRACTION1] = BEGIN, False
    step[S_LETTER, CONTRACTION2], mark[S_LETTER, CONTRACTION2] = CONTRACTION1, False
    for symbol, state in ((S_APOSTROPHE1, CONTRACTION1), (S_APOSTROPHE2, CONTRACTION2)):
        step[symbol] = state
        step[symbol, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
        mark[symbol, [IN_OTHER, AFTER_BLANK]] = False
    step[S_SPACE] = IN_SPACE
    mark[S_SPACE, IN_SPACE] = False
    step[S_LAST_BLANK] = AFTER_BLANK
    step[S_LAST_SPACE] = BEGIN
    step[S_END] = BEGIN
    step[S_NONE] = np.arange(8)
    mark[S_NONE] = False
    return step, mark


NEXT, BEGINS = (t.ravel() for t in _machine())


@lru_cache(4)
def tokenizer_at(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def character_classes(path: str) -> np.ndarray:
    """The class of every code point, found by asking the tokenizer what it keeps together."""
    split = tokenizer_at(path).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110001, OTHER, np.uint8)
    # The other planes hold private or no characters.
    for low in [*range(0, 0x40000, 0x2000), *range(0xE0000, 0xE2000, 0x2000)]:
        codes = [c for c in range(low, low + 0x2000) if not 0xD800 <= c < 0xE000]
        after_a = {end for _, (_, end) in split("".join(f"a{chr(c)}1" for c in codes))}
        after_mark = {end for _, (_, end) in split("".join(f"!{chr(c)}a" for c in codes))}
        for i, c in enumerate(codes):
            if 3 * i + 1 not in after_a:
                out[c] = LETTER
            elif 3 * i + 2 not in after_a and c != 32:
                out[c] = NUMBER
            elif 3 * i + 1 in after_mark:
                out[c] = SPACE
    out[32] = BLANK
    return out


def symbols(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Machine symbols of a text; ``last`` holds the places of last characters of texts."""
    kind = kinds[codes]
    blank = kind >= BLANK
    then_blank = np.append(blank[1:], True)
    then_blank[last] = True
    out = kind.copy()
    out[blank] = S_SPACE
    ends = blank & ~then_blank
    out[ends & (kind == BLANK)] = S_LAST_BLANK
    out[ends & (kind == SPACE)] = S_LAST_SPACE
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        padded = np.append(codes, [0, 0])
        stop = last[np.searchsorted(last, quote)]
        one = np.where(quote + 1 <= stop, padded[quote + 1], 0)
        two = np.where(quote + 2 <= stop, padded[quote + 2], 0)
        short = np.isin(one, [115, 116, 109, 100])  # s t m d
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        out[quote[short]] = S_APOSTROPHE1
        out[quote[long]] = S_APOSTROPHE2
    return out


def chunk_maps(table: np.ndarray) -> np.ndarray:
    """Exit state of every chunk (row) for every entry state."""
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (len(table), 8)).copy()
    for t in range(table.shape[1]):
        maps = NEXT[(table[:, t] * np.uint8(8))[:, None] + maps]
    return maps


def scanned(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the maps, in log steps."""
    step = 1
    while step < len(maps):
        done = maps.copy()
        done[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        maps = done
        step *= 2
    return maps


def token_begins(symbol: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin. Every text is entered in the state BEGIN."""
    # An end symbol before each text resets the machine.
    n = len(symbol) + len(firsts)
    shifted = np.arange(len(symbol)) + np.searchsorted(firsts, np.arange(len(symbol)), "right")
    full = np.full(-(-n // CHUNK) * CHUNK, S_NONE, np.uint8)
    full[:n] = S_END
    full[shifted] = symbol
    table = full.reshape(-1, CHUNK)
    entry = np.zeros(len(table), np.uint8)
    entry[1:] = scanned(chunk_maps(table))[:-1, BEGIN]
    begins = np.empty(table.shape, bool)
    columns = np.ascontiguousarray(table.T) * np.uint8(8)
    state = entry
    for t in range(CHUNK):
        at = columns[t] + state
        begins[:, t] = BEGINS[at]
        state = NEXT[at]
    return np.flatnonzero(begins.ravel()[shifted])


class Piece:
    """Some texts, or a part of a long one, with their pre-tokens."""

    def __init__(self, codes: np.ndarray, kinds: np.ndarray, firsts: np.ndarray, rows: np.ndarray) -> None:
        self.codes = codes
        self.rows = rows  # of each text here, the row of the batch
        last = np.append(firsts[1:], len(codes)) - 1
        self.begin = token_begins(symbols(codes, kinds, firsts, last), firsts)
        self.end = np.append(self.begin[1:], len(codes))
        self.owner = rows[np.searchsorted(firsts, self.begin, "right") - 1]

    def text(self, k: int) -> str:
        return self.codes[self.begin[k] : self.end[k]].tobytes().decode("utf-32-le")

    def texts(self, which: np.ndarray) -> list[str]:
        whole = self.codes.tobytes().decode("utf-32-le")
        return [whole[a:b] for a, b in zip(self.begin[which].tolist(), self.end[which].tolist())]

    def spelled(self, which: np.ndarray) -> np.ndarray:
        """A hash of each of these pre-tokens, from its characters."""
        out = np.zeros(len(which), np.uint64)
        alive, at, end = np.arange(len(which)), self.begin[which].copy(), self.end[which]
        while len(alive):
            out[alive] = out[alive] * np.uint64(0xD6E8FEB86659FD93) + self.codes[at].astype(np.uint64) + np.uint64(1)
            at = at + 1
            on = at < end[alive]
            alive, at = alive[on], at[on]
        return mix(out)


class Slots:
    """Numbers for hashes, in order of arrival: a sorted array and a small dictionary of the newest."""

    NEW = 1 << 16

    def __init__(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.new: dict[int, int] = {}
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those not held."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            held = self.hashes[at] == hashes
            out[held] = self.slots[at[held]]
        left = np.flatnonzero(out < 0)
        if self.new:
            out[left] = [self.new.get(h, -1) for h in hashes[left].tolist()]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        slots = np.arange(self.size, self.size + len(hashes))
        self.new.update(zip(hashes.tolist(), slots.tolist()))
        self.size += len(hashes)
        if len(self.new) > self.NEW:
            hashes = np.concatenate([self.hashes, np.fromiter(self.new.keys(), np.uint64, len(self.new))])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            self.slots = np.concatenate([self.slots, np.fromiter(self.new.values(), np.int32, len(self.new))])[order]
            self.new = {}
        return slots


def _cut(codes: np.ndarray, kinds: np.ndarray, stop: int) -> int:
    """A place up to or after ``stop`` where a single blank comes between other characters: always a token's begin."""
    for a, b in ((max(0, stop - PIECE), stop), (stop, len(codes))):
        kind = kinds[codes[a : b + 1]]
        at = np.flatnonzero((kind[1:-1] == BLANK) & (kind[:-2] < BLANK) & (kind[2:] < BLANK))
        if len(at):
            return a + 1 + int(at[-1] if b == stop else at[0])
    return len(codes)


def pieces(texts: pa.Array, kinds: np.ndarray):
    """The texts of a column in pieces of bounded size, empty ones left out."""
    data, offsets = column_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        raw = data[offsets[at] : offsets[stop]].tobytes()
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        chars = np.r_[0, np.cumsum(lead)][offsets[at : stop + 1] - offsets[at]]
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        filled = np.flatnonzero(np.diff(chars))
        if len(filled):
            if stop == at + 1 and len(codes) > 2 * PIECE:
                begin = 0
                while begin < len(codes):
                    end = len(codes) if len(codes) - begin <= 2 * PIECE else begin + _cut(codes[begin:], kinds, PIECE)
                    yield Piece(codes[begin:end], kinds, np.zeros(1, np.int64), np.array([at]))
                    begin = end
            else:
                yield Piece(codes, kinds, chars[filled], filled + at)
        at = stop
