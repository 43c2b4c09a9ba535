"""SentencePiece ids by a table of distinct marked words, and texts from ids.

The library marks each space and puts a mark before the text. Where no piece
has a mark after another character, no piece crosses from one marked word (a
run of marks and what follows it) to the next, so words can be segmented by
themselves. Words are counted over all texts; each word that occurs more than
once is segmented once, in a table, and its ids are joined back to its places:

* the most frequent words, up to a bound of rows and bytes, are broadcast;
* the words of the table beyond that are joined by a shuffle of (document, word);
* a word that occurs once in all texts is segmented where it stands.

So every distinct word goes through the library once (a broadcast word never
again). Words are looked up by 64-bit hash in the broadcast part and compared
as text in the join.

Rows: a null or empty text has no ids. Repeated rows, repeated and null
document ids are kept as they are.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from pairloom.llm.frames import id_and_text, tuned
from pairloom.llm.words import batches_of, column_bytes, mix
from pairloom.session import stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
# Bounds of the broadcast part of the table.
HEAD_WORDS = 4_000_000
HEAD_BYTES = 96 << 20
BATCH_BYTES = 2 << 20
# Bytes of a word that is hashed together with others.
SHORT = 64
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(2)
def model_at(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, refused where words can not be segmented by themselves."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    rules = spec.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError("the model normalises texts: words can not be cut before it does")
    if spec.trainer_spec.treat_whitespace_as_suffix or any(MARK in p.piece.lstrip(MARK) for p in spec.pieces):
        raise ValueError("a piece of the model crosses a whitespace marker")
    return model


def segmented(words: list[str], path: str) -> list[list[int]]:
    """Ids of marked words, each given without its first mark."""
    model = model_at(path)
    alone = [model.piece_to_id(MARK)]
    return [ids if word else alone for word, ids in zip(words, model.encode(words, num_threads=1))]


# --- words of a column ----------------------------------------------------------


class Words:
    """The marked words of some texts, each without its first mark: the space before it, or the mark before the text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        self.data, self.offsets = column_bytes(texts)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        space = self.data[first:last] == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0] - first
        begins[heads] = True
        at = np.flatnonzero(begins)
        self.end = np.append(at[1:], last - first)[: len(at)] + first
        is_head = np.zeros(len(at), bool)
        is_head[np.searchsorted(at, heads)] = True
        self.begin = at + first + ~is_head
        self.per_row = np.diff(np.searchsorted(at + first, self.offsets))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A hash of each word from its bytes: of short ones for all of one length at a time, in blocks of eight bytes."""
        out = np.empty(len(self.begin), np.uint64)
        length = self.end - self.begin
        long = np.flatnonzero(length > SHORT)
        raw = memoryview(self.data)
        digests = (blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(self.begin[long].tolist(), self.end[long].tolist()))
        out[long] = np.frombuffer(b"".join(digests), np.uint64)
        order = np.argsort(length, kind="stable")[: len(length) - len(long)]
        sizes, starts = np.unique(length[order], return_index=True)
        for size, a, b in zip(sizes.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist()):
            which = order[a:b]
            value = np.full(len(which), size, np.uint64)
            for at in range(0, size, 8):
                block = np.zeros(len(which), np.uint64)
                for i in range(at, min(at + 8, size)):
                    block |= self.data[self.begin[which] + i].astype(np.uint64) << np.uint64(8 * (i - at))
                value = mix((value ^ block) * BASE)
            out[which] = value
        return out

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.data
        return [raw[a:b].tobytes().decode() for a, b in zip(self.begin[which].tolist(), self.end[which].tolist())]

    def column(self, which: np.ndarray) -> pa.Array:
        """Some of the words as a string column."""
        length = self.end[which] - self.begin[which]
        return pa.StringArray.from_buffers(
            len(which),
            pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int32)),
            pa.py_buffer(self.data[spans(self.begin[which], length)]),
        )


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def column_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for a, b in batches_of(column, BATCH_BYTES):
        yield a, b, Words(column.slice(a, b - a))


# --- the table -------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts. Counted per batch, then by Spark, map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in column_words(batch.column(0)):
                _, first, count = np.unique(words.hashes, return_index=True, return_counts=True)
                if len(first):
                    yield pa.RecordBatch.from_arrays([words.column(first), pa.array(count)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of the words that occur more than once, each segmented once. ``ids`` are 32-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(i, "<u4").tobytes() for i in segmented(batch.column(0).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    repeated = word_counts(docs).where("n > 1")
    return stored(repeated.mapInArrow(run, "word string, n long, ids binary"), "marked-words")


def _band() -> F.Column:
    return F.floor(F.log2("n") * 16)


def head_cut(table: DataFrame, most: int, most_bytes: int) -> tuple[int | None, bool]:
    """The lowest count band whose words are broadcast (None: no band is), and whether words are left out."""
    size = F.sum(F.length("ids") + 16).alias("size")
    bands = table.groupBy(_band().alias("band")).agg(F.count("*").alias("rows"), size).collect()
    cut, rows, held = None, 0, 0
    for band in sorted(bands, key=lambda b: -b["band"]):
        rows, held = rows + band["rows"], held + band["size"]
        if rows > most or held > most_bytes:
            return cut, True
        cut = band["band"]
    return cut, False


class Head:
    """The broadcast words: sorted hashes, and the ids of each in one flat array."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        first = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        # Two words of one hash: neither is looked up here.
        twice = np.zeros(len(hashes), bool)
        twice[1:] = hashes[1:] == hashes[:-1]
        twice[:-1] |= twice[1:]
        order = order[~twice]
        self.hashes = hashes[~twice]
        self.begin, self.count = first[order], counts[order].astype(np.int64)
        self.ids = ids

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def head_of(table: DataFrame, cut: int | None) -> Head:
    """The words from a band on, packed by the tasks and put together on the driver, which the bounds keep small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            data, offsets = column_bytes_of(ids)
            packed = [word_hashes_of(batch.column(0)).tobytes(), (np.diff(offsets) // 4).astype("<i4").tobytes(), data[offsets[0] : offsets[-1]].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["hashes", "counts", "ids"])

    chosen = table.where(F.lit(False) if cut is None else _band() >= cut).select("word", "ids")
    rows = chosen.mapInArrow(run, "hashes binary, counts binary, ids binary").collect()
    hashes, counts, ids = (b"".join(bytes(r[i]) for r in rows) for i in range(3))
    return Head(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, "<i4"), np.frombuffer(ids, "<u4").astype(np.int32))


def column_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def word_hashes_of(column: pa.Array) -> np.ndarray:
    """Hashes of words given one by one, equal to those of ``Words``."""
    words = Words.__new__(Words)
    words.data, offsets = column_bytes(column)
    words.begin, words.end = offsets[:-1], offsets[1:]
    return words._hashes()


# --- ids of documents --------------------------------------------------------------


def _ids_of(words: Words, head: Head, extra: dict[str, bytes], path: str) -> pa.Array:
    """The ids of each text; words neither in the head nor in ``extra`` are segmented here."""
    hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    slot = head.find(hashes)
    begin, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    known = slot >= 0
    begin[known], count[known] = head.begin[slot[known]], head.count[slot[known]]
    pool = head.ids
    rare = np.flatnonzero(~known)
    if len(rare):
        texts = words.texts(first[rare])
        single = [t for t in texts if t not in extra]
        fresh = dict(zip(single, segmented(single, path)))
        ids = [fresh[t] if t in fresh else np.frombuffer(extra[t], "<u4").tolist() for t in texts]
        count[rare] = [len(i) for i in ids]
        begin[rare] = len(pool) + np.cumsum(count[rare]) - count[rare]
        own = np.fromiter(chain.from_iterable(ids), np.int32, int(count[rare].sum()))
    else:
        own = np.zeros(0, np.int32)
    count_at = count[inverse]
    places = spans(begin[inverse], count_at)
    flat = np.empty(len(places), np.int32)
    inside = places < len(pool)
    flat[inside], flat[~inside] = pool[places[inside]], own[places[~inside] - len(pool)]
    ends = np.r_[0, np.cumsum(count_at)][np.r_[0, np.cumsum(words.per_row)]]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _beyond_head(docs: DataFrame, table: DataFrame, cut: int | None, head) -> DataFrame:
    """(doc_id, text_key, words, ids) for the words of the table that are not broadcast. Such words are rare: no key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in column_words(batch.column(2)):
                row = np.repeat(np.arange(len(words.per_row)), words.per_row)
                missing = np.flatnonzero(head.value.find(words.hashes) < 0)
                # A word once for each text.
                order = missing[np.lexsort((words.hashes[missing], row[missing]))]
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (words.hashes[order][1:] != words.hashes[order][:-1])
                order = order[new]
                at = pa.array(a + row[order])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.column(order)], ["doc_id", "text_key", "word"])

    asked = docs.mapInArrow(run, "doc_id long, text_key long, word string").distinct()
    rest = table.where(F.lit(True) if cut is None else _band() < cut).select("word", "ids")
    pair = F.struct("word", "ids")
    return asked.join(rest, "word").groupBy("doc_id", "text_key").agg(F.collect_list(pair).alias("extra"))


def encoded(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = MODEL,
    head_words: int = HEAD_WORDS,
    head_bytes: int = HEAD_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, ids) of every row: the library's ids of its text, without begin and end.

    ``with_text`` adds the text that the ids decode to, decoded by the same
    Python worker: one more would hold the library and a batch once more.
    """
    spark = tuned(docs.sparkSession)
    model_at(path)
    docs = id_and_text(docs, id_col, text_col)
    table = word_table(docs, path)
    cut, left = head_cut(table, head_words, head_bytes)
    head = spark.sparkContext.broadcast(head_of(table, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in column_words(batch.column(1)):
                extra = {}
                if left:
                    for pairs in batch.column(2).slice(a, b - a).to_pylist():
                        extra.update((p["word"], p["ids"]) for p in pairs or ())
                ids = _ids_of(words, head.value, extra, path)
                columns = [batch.column(0).slice(a, b - a), ids]
                if with_text:
                    columns.append(_texts_of(ids, path))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    if left:
        keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        rest = _beyond_head(keyed, table, cut, head).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        docs = keyed.join(rest, same, "left").select("doc_id", "text", "extra")
    return docs.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if with_text else ""))


def decoded(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """Adds the library's text of each list of ids. A null list has a null text; so has one with a null or an id the model lacks."""
    size = model_at(path).get_piece_size()
    usable = F.forall(ids_col, lambda i: F.coalesce((i >= 0) & (i < size), F.lit(False)))
    return rows.withColumn(text_col, F.when(F.col(ids_col).isNotNull() & usable, _decoder(path)(F.col(ids_col).cast("array<int>"))))


def _texts_of(ids: pa.Array, path: str) -> pa.Array:
    """The library's text of each list; a list that it can not decode is read without the ids it lacks."""
    model, flat = model_at(path), ids.flatten()
    whole = not flat.null_count and (not len(flat) or 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < model.get_piece_size())
    lists = (one.as_py() or [] for one in ids)
    if not whole:
        lists = ([i for i in one if i is not None and 0 <= i < model.get_piece_size()] for one in lists)
    return pa.array([model.decode(one) for one in lists], pa.string())


def _decoder(path: str):
    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        return _texts_of(ids, path)

    return text_of


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and the text they decode to."""
    rows = encoded(docs, with_text=True, **options)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
