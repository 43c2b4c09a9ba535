"""Token ids in a binary format of shuffled planes.

Documents are encoded, ordered by id and packed into chunks of whole documents.
The ids of a chunk form one stream, cut into blocks of a fixed number of ids. A
block is transposed into byte planes (or bit planes), each compressed with
zstandard; the chunk carries an index of its blocks and planes and the lengths
of its documents. High planes are nearly constant, so they cost nothing.

A shard is a range of document ids. Chunks are rows of Parquet files, so they
are written with Spark's commit protocol and read from any store.
"""

from collections.abc import Iterator
from itertools import chain
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
import zstandard

from pairloom.llm.frames import id_and_text, shuffle_tasks, tuned
from pairloom.llm.fst import special_apart
from pairloom.llm.pretokens import Piece, Slots, character_classes, pieces, tokenizer_at
from pairloom.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
LEVEL = 3
BYTE, BIT = "byte", "bit"
KEPT_PRETOKENS = 1_000_000

CHUNKS = (
    "shard int, chunk int, mode string, n_ids long, doc_ids binary, lengths binary, "
    "block_ids array<int>, plane_sizes array<array<int>>, planes binary"
)


# --- planes -----------------------------------------------------------------


def to_planes(ids: np.ndarray, mode: str = BYTE) -> list[bytes]:
    """Planes of little-endian 32-bit ids, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == BYTE:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str = BYTE) -> np.ndarray:
    if mode == BYTE:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def packed(ids: np.ndarray, mode: str = BYTE, block: int = BLOCK_IDS, level: int = LEVEL):
    """(ids per block, compressed sizes per block and plane, all planes in a row)."""
    press = zstandard.ZstdCompressor(level=level)
    counts, sizes, out = [], [], []
    for at in range(0, len(ids), block):
        planes = [press.compress(p) for p in to_planes(ids[at : at + block], mode)]
        counts.append(len(ids[at : at + block]))
        sizes.append([len(p) for p in planes])
        out += planes
    return counts, sizes, b"".join(out)


def unpacked(counts: list[int], sizes: list[list[int]], planes: bytes, mode: str = BYTE) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    at, out = 0, []
    for n, row in zip(counts, sizes):
        parts = []
        for size in row:
            parts.append(open_.decompress(planes[at : at + size], max_output_size=max(1, n)))
            at += size
        out.append(from_planes(parts, n, mode))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


# --- encoding ---------------------------------------------------------------


class Encoder:
    """Ids of texts by the library, each distinct pre-token encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        self.encode = tokenizer_at(path).encode_batch_fast
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)  # of each slot, and the end of the last one

    def _learn(self, texts: list[str]) -> None:
        """Ids for the newest slots."""
        ids = [e.ids for at in range(0, len(texts), 4096) for e in self.encode(texts[at : at + 4096], add_special_tokens=False)]
        size = self.slots.size
        while size + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        begin = int(self.first[size - len(ids)])
        self.first[size - len(ids) + 1 : size + 1] = begin + np.cumsum([len(one) for one in ids])
        end = int(self.first[size])
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[begin:end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - begin)

    def piece(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece in order, and how many each pre-token has."""
        hashes, first, inverse = np.unique(piece.spelled(np.arange(len(piece.begin))), return_index=True, return_inverse=True)
        if self.slots.size > KEPT_PRETOKENS:
            self.clear()
        slot = self.slots.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self.slots.add(hashes[new])
            self._learn(piece.texts(first[new]))
        slot = slot[inverse]
        begin, count = self.first[slot], self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)
        return self.pool[at], count


_ENCODERS: dict[str, Encoder] = {}


def encoded(texts: pa.Array, kinds: np.ndarray, path: str) -> list[np.ndarray]:
    """The library's ids of every text of a column; none for a null or empty one."""
    encoder = _ENCODERS.setdefault(path, Encoder(path))
    whole: dict[int, np.ndarray] = {}

    def library(special: list[str]) -> list[int]:
        found = [np.array(e.ids, np.uint32) for e in encoder.encode(special, add_special_tokens=False)]
        whole.update(enumerate(found))
        return [len(f) for f in found]

    rest, counts = special_apart(texts, path, library)
    parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for number, row in enumerate(np.flatnonzero(counts).tolist()):
        parts[row].append(whole[number])
    for piece in pieces(rest, kinds):
        ids, count = encoder.piece(piece)
        per_row = np.bincount(piece.owner - piece.rows[0], weights=count, minlength=int(piece.rows[-1] - piece.rows[0]) + 1)
        at = 0
        for row, n in enumerate(per_row.astype(np.int64).tolist(), int(piece.rows[0])):
            if n:
                parts[row].append(ids[at : at + n])
            at += n
    return [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


# --- files ------------------------------------------------------------------


def _shards(docs: DataFrame, shards: int) -> DataFrame:
    """Documents with their shard, a range of ids, in order within it. Shards are only ranges: any cut gives the same files in a row."""
    dealt = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")


def write_ids(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    mode: str = BYTE,
    block: int = BLOCK_IDS,
    chunk: int = CHUNK_IDS,
) -> None:
    """Write the ids of all documents, each with ``end_id`` after it, in ascending order of their ids.

    A null or empty text has the end id alone. Rows with a null id are left
    out; rows that share an id follow each other in order of their texts.
    """
    spark = tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    kinds = spark.sparkContext.broadcast(character_classes(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = 0, 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            counts, sizes, planes = packed(np.concatenate(ids), mode, block)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([mode]),
                    pa.array([held], pa.int64()),
                    pa.array([np.array(names, "<i8").tobytes()], pa.binary()),
                    pa.array([np.array([len(i) for i in ids], "<i8").tobytes()], pa.binary()),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([sizes], pa.list_(pa.list_(pa.int32()))),
                    pa.array([planes], pa.binary()),
                ],
                ["shard", "chunk", "mode", "n_ids", "doc_ids", "lengths", "block_ids", "plane_sizes", "planes"],
            )

        for batch in batches:
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
            for doc_id, one in zip(batch.column(1).to_pylist(), encoded(batch.column(2), kinds.value, tokenizer)):
                names.append(doc_id)
                ids.append(np.append(one, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= chunk:
                    yield flushed()
                    ids, names, held, number = [], [], 0, number + 1
        if ids:
            yield flushed()

    _shards(docs, shuffle_tasks(docs)).mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, digest=None, schema: str = "ids array<long>") -> DataFrame:
    """(shard, chunk, place, doc_id, start_in_chunk, n_tokens, ...) of every document in the files.

    ``digest`` maps the ids of one document to the values of ``schema``;
    without it the ids themselves are returned.
    """
    tuned(spark)
    names = [f.split()[0] for f in schema.split(", ")]
    give = digest or (lambda ids: (ids.astype(np.int64).tolist(),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ids = unpacked(row["block_ids"], row["plane_sizes"], row["planes"], row["mode"])
                ends = np.cumsum(lengths)
                values = [give(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["shard"]), pa.int32()),
                        pa.array(np.full(n, row["chunk"]), pa.int32()),
                        pa.array(np.arange(n), pa.int64()),
                        pa.array(doc_ids),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        *(pa.array([v[i] for v in values]) for i in range(len(names))),
                    ],
                    ["shard", "chunk", "place", "doc_id", "start_in_chunk", "n_tokens", *names],
                )

    head = "shard int, chunk int, place long, doc_id long, start_in_chunk long, n_tokens long, "
    return spark.read.parquet(path).mapInArrow(run, head + schema)


def chunk_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, start): ids before each chunk, from the sizes in the index alone."""
    from pyspark.sql import Window

    chunks = spark.read.parquet(path).select("shard", "chunk", "n_ids")
    # As many rows as shards; the running sum over them needs one task.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    inner = chunks.select("shard", "chunk", F.coalesce(inside, F.lit(0)).alias("inner"))
    return inner.join(F.broadcast(shards), "shard").select("shard", "chunk", (F.col("base") + F.col("inner")).alias("start"))


def binary_output(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files, read them back, and return (doc_id, start, n_tokens, ids_crc32) of every document in them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-planes")
    write_ids(docs, path, **options)
    rows = read_ids(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")
    return rows.join(chunk_starts(spark, path), ["shard", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("start_in_chunk")).alias("start"), "n_tokens", "ids_crc32"
    )
