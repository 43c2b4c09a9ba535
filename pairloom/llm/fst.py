"""Token counts by a compiled finite-state tokenizer.

Two machines in a row. The first (``pretokens``) marks where pre-tokens begin;
its chunk maps compose through a parallel prefix scan. The second is a
deterministic transducer over characters: a state is a prefix of pre-tokens,
and a transition carries the tokens it adds to the library's count for the
prefix (a merge can make that negative), so the sum along a pre-token is its
count. All pre-tokens of a piece are run side by side. What leaves the compiled
states is counted by the library, each distinct pre-token once.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.frames import id_and_text, mapped, most_frequent, tuned
from pairloom.llm.pretokens import Piece, Slots, character_classes, pieces, tokenizer_at
from pairloom.llm.words import column_bytes
from pairloom.session import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SAMPLE_DOCS = 2_000
MAX_STATES = 1 << 18
OVER = 1024
KEPT_COUNTS = 1_000_000


class Transducer:
    """Transitions (state, character) -> (state, tokens added) in an open hash table."""

    def __init__(self, pretokens: list[str], count, max_states: int = MAX_STATES) -> None:
        step: dict[tuple[int, str], int] = {}
        prefix = [""]
        for p in pretokens:
            if len(prefix) + len(p) > max_states:
                break
            state = 0
            for at, c in enumerate(p):
                new = step.get((state, c))
                if new is None:
                    new = step[state, c] = len(prefix)
                    prefix.append(p[: at + 1])
                state = new
        total = np.array([0, *count(prefix[1:])], np.int32)
        self.states = len(prefix)
        keys = np.array([(s << 21) | ord(c) for s, c in step], np.int64)
        to = np.array(list(step.values()), np.int32)
        added = total[to] - total[keys >> 21] if len(keys) else np.zeros(0, np.int32)
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.added = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            # One of those that want a free slot gets it, the others go on.
            free = self.keys[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.to[at], self.added[at] = keys[won], to[won], added[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and tokens added; -1 where there is no transition."""
        keys = (state.astype(np.int64) << 21) | codes
        slot = self._slots(keys)
        held = self.keys[slot]
        to, added = self.to[slot], self.added[slot]
        other = np.flatnonzero(held != keys)
        while len(other):
            gone = other[held[other] < 0]
            to[gone], added[gone] = -1, 0
            other = other[held[other] >= 0]
            slot[other] = (slot[other] + 1) & self.mask
            held[other] = self.keys[slot[other]]
            to[other], added[other] = self.to[slot[other]], self.added[slot[other]]
            other = other[held[other] != keys[other]]
        return to, added

    def run(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The count of each pre-token, -1 for those that leave the machine."""
        count = np.zeros(len(begin), np.int32)
        alive = np.arange(len(begin))
        state = np.zeros(len(begin), np.int32)
        at = begin.copy()
        while len(alive):
            state, added = self.follow(state, codes[at])
            lost = state < 0
            count[alive] += added
            count[alive[lost]] = -1
            at = at + 1
            on = ~lost & (at < end[alive])
            alive, state, at = alive[on], state[on], at[on]
        return count


def _library_counts(path: str):
    """Counts of texts by the library; special strings inside them as it handles them."""
    encode = tokenizer_at(path).encode_batch_fast

    def count(texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [len(e) for e in encode(texts[at : at + 4096], add_special_tokens=False)]
        return out

    return count


class Counts:
    """Counts of pre-tokens outside the machine; forgotten as a whole beyond KEPT_COUNTS."""

    def __init__(self) -> None:
        self.slots, self.counts = Slots(), np.zeros(1 << 16, np.int64)

    def of(self, piece: Piece, which: np.ndarray, library) -> np.ndarray:
        hashes, first, inverse = np.unique(piece.spelled(which), return_index=True, return_inverse=True)
        if self.slots.size > KEPT_COUNTS:
            self.__init__()
        slot = self.slots.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self.slots.add(hashes[new])
            while self.slots.size > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[slot[new]] = library(piece.texts(which[first[new]]))
        return self.counts[slot][inverse]


_COUNTS: dict[str, Counts] = {}


def count_tokens(texts: pa.Array, kinds: np.ndarray, machine: Transducer, path: str) -> np.ndarray:
    """The library's token count of every text of a column; 0 for a null or empty one."""
    library = _library_counts(path)
    known = _COUNTS.setdefault(path, Counts())
    texts, out = special_apart(texts, path, library)
    for piece in pieces(texts, kinds):
        count = machine.run(piece.codes, piece.begin, piece.end).astype(np.int64)
        lost = np.flatnonzero(count < 0)
        if len(lost):
            count[lost] = known.of(piece, lost, library)
        np.add.at(out, piece.owner, count)
    return out


def special_apart(texts: pa.Array, path: str, library) -> tuple[pa.Array, np.ndarray]:
    """Texts with special strings are left to the library as a whole."""
    counts = np.zeros(len(texts), np.int64)
    strings = [t.content for t in tokenizer_at(path).get_added_tokens_decoder().values()]
    texts = texts.fill_null("")
    special = np.zeros(len(texts), bool)
    for s in strings:
        special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if special.any():
        at = np.flatnonzero(special)
        counts[at] = library([texts[int(i)].as_py() for i in at])
        texts = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)
    return texts, counts


def compiled(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, max_states: int = MAX_STATES) -> tuple[np.ndarray, Transducer]:
    """Character classes and a transducer for the pre-tokens of a bounded sample of the documents, frequent ones first.

    The sample decides only what is compiled, not any count.
    """
    kinds = character_classes(path)
    shared = docs.sparkSession.sparkContext.broadcast(kinds)
    total = docs.count()
    mod = max(1, total // sample_docs)

    def seen(batch: pa.RecordBatch):
        counts: dict[str, int] = {}
        for piece in pieces(batch.column(0), shared.value):
            _, first, times = np.unique(piece.spelled(np.arange(len(piece.begin))), return_index=True, return_counts=True)
            for p, n in zip(piece.texts(first), times.tolist()):
                if len(p) <= 32:
                    counts[p] = counts.get(p, 0) + n
        return {"pretoken": list(counts), "n": list(counts.values())} if counts else None

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(mod)) == 0).select("text")
    counts = mapped(chosen, "pretoken string, n long", seen).groupBy("pretoken").agg(F.sum("n").alias("n"))
    rows = most_frequent(stored(counts, "fst-pretokens"), "n", max_states // 4).collect()
    rows.sort(key=lambda r: (-r.n, r.pretoken))
    return kinds, Transducer([r.pretoken for r in rows], _library_counts(path), max_states)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, over: int = OVER, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document row.

    Counts are the library's, without added special tokens. A null or empty
    text has no bytes and no tokens; a row with a null id keeps its row.
    """
    spark: SparkSession = tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(compiled(docs, path, sample_docs))

    def run(batch: pa.RecordBatch):
        kinds, machine = shared.value
        _, offsets = column_bytes(batch.column(1))
        return {
            "doc_id": batch.column(0),
            "n_bytes": np.diff(offsets),
            "n_tokens": count_tokens(batch.column(1), kinds, machine, path),
        }

    return mapped(docs, "doc_id long, n_bytes long, n_tokens long", run).withColumn("over_limit", F.col("n_tokens") > over)
