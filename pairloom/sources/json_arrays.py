"""One JSON array or object in a file, read by many tasks.

The file is read as text records that end at commas, which Spark splits by
byte ranges like lines. Whether a comma parts two elements depends on what
came before, so a first pass gives each range its map from the state at its
begin to the state at its end: quotes turn text on and off, and brackets
outside of texts move the depth. Maps are kept for both entry states and
composed by prefix sums over the ranges, of which there are as many as splits.
A second pass knows the state, the depth and the element number at the begin
of its range, and cuts elements at the commas of depth one. Elements that lie
in one range are ready; pieces of the others are put together by element.

A comma can not follow an unfinished escape in JSON, so no escape crosses
from one record to the next.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.session import stored

SEPARATOR = ","
# Records are scanned together up to about so many bytes.
SCANNED_AT_ONCE = 4 << 20

_QUOTE, _BACKSLASH, _COMMA = 34, 92, 44
_OPEN = np.zeros(256, np.int8)
_OPEN[[91, 123]] = 1
_OPEN[[93, 125]] = -1

RANGES = (
    "file long, block long, turns int, depth_outside long, depth_inside long, "
    "commas_outside map<int,long>, commas_inside map<int,long>"
)
PIECES = "file long, pos long, block long, piece long, whole boolean, last boolean, text string"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Text between commas with its range. Rows of a range are read in order by one task."""
    meta = F.col("_metadata")
    records = spark.read.option("lineSep", SEPARATOR).text(path)
    # The path is longer than most records: its hash stands for it.
    return records.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), "value")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, part): the hash and the path of each file."""
    paths = spark.read.format("binaryFile").load(path).select(F.col("path").alias("part"))
    return paths.select(F.xxhash64("part").alias("file"), "part")


def _structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: texts begun or ended up to and with it, moves of the depth, and whether it is a comma."""
    place = np.arange(len(raw))
    other = np.maximum.accumulate(np.where(raw != _BACKSLASH, place, -1))
    before = np.r_[-1, other[:-1]]
    quote = (raw == _QUOTE) & ((place - 1 - before) % 2 == 0)
    return np.cumsum(quote), _OPEN[raw], raw == _COMMA


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """((file, block), records) in order: a range in portions of bounded size, however the batches are cut."""
    key, held, size = None, [], 0
    for batch in batches:
        files, blocks = (batch.column(i).to_numpy() for i in (0, 1))
        values = batch.column(2).to_pylist()
        new = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(values)]):
            here = (int(files[a]), int(blocks[a])) if b else key
            if held and (here != key or size > SCANNED_AT_ONCE):
                yield key, held
                held, size = [], 0
            key = here
            held += values[a:b]
            size += sum(map(len, values[a:b]))
    if held:
        yield key, held


def _bytes_of(records: list[str]) -> np.ndarray:
    """The records as they stand in the file: each was followed by a comma. The last of a file was not, which adds one there."""
    return np.frombuffer((SEPARATOR.join(records) + SEPARATOR).encode(), np.uint8)


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row() -> pa.RecordBatch:
        commas = [pa.array([list(c.items())], pa.map_(pa.int32(), pa.int64())) for c in (outside, inside)]
        longs = [pa.array([v], pa.int64()) for v in (*key, *depth)]
        return pa.RecordBatch.from_arrays([*longs[:2], pa.array([turns], pa.int32()), *longs[2:], *commas], _names(RANGES))

    key, turns, depth, outside, inside = None, 0, [0, 0], Counter(), Counter()
    for at, records in _portions(batches):
        if at != key:
            if key is not None:
                yield row()
            key, turns, depth, outside, inside = at, 0, [0, 0], Counter(), Counter()
        quotes, moves, comma = _structure(_bytes_of(records))
        for entry, commas in ((0, outside), (1, inside)):
            out = (quotes + turns + entry) % 2 == 0
            level = depth[entry] + np.cumsum(moves * out)
            for place, n in zip(*np.unique(level[comma & out], return_counts=True)):
                commas[int(place)] += int(n)
            depth[entry] = int(level[-1])
        turns = (turns + int(quotes[-1])) % 2
    if key is not None:
        yield row()


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def range_entries(records: DataFrame) -> DataFrame:
    """State at the begin of each range: (file, block, inside, depth, pos), by prefix sums over the maps of the ranges.

    ``last`` is the number of the last element of the file, ``faulty`` a file
    that does not end outside of texts at depth zero.
    """
    maps = stored(records.mapInArrow(_range_maps, RANGES), "ranges")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inside = (F.coalesce(F.sum("turns").over(before), zero) % 2 == 1).alias("inside")
    chosen = maps.select("*", inside).select(
        "file", "block", "turns", "inside",
        F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth_outside")).alias("move"),
        F.when(F.col("inside"), F.col("commas_inside")).otherwise(F.col("commas_outside")).alias("commas"),
    )
    deep = chosen.withColumn("depth", F.coalesce(F.sum("move").over(before), zero))
    cuts = F.coalesce(F.element_at("commas", (1 - F.col("depth")).cast("int")), zero)
    counted = deep.withColumns({"cuts": cuts, "pos": F.coalesce(F.sum(cuts).over(before), zero)})
    whole = Window.partitionBy("file")
    ends = (F.sum("move").over(whole) != 0) | (F.sum("turns").over(whole) % 2 != 0)
    return counted.select("file", "block", F.col("inside").cast("int"), "depth", "pos", F.sum("cuts").over(whole).alias("last"), ends.alias("faulty"))


def _cutter(entries: dict[tuple[int, int], tuple[int, int, int, int]]):
    """A function from records to elements and pieces of elements; ``entries`` has the state at the begin of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, depth, pos, last, piece, fresh = None, 0, 0, 0, 0, 0, False
        for at, records in _portions(batches):
            if at != key:
                # What a range begins with may have begun before it.
                key, piece, fresh = at, 0, False
                turns, depth, pos, last = entries[key]
            raw = _bytes_of(records)
            quotes, moves, comma = _structure(raw)
            outside = (quotes + turns) % 2 == 0
            level = depth + np.cumsum(moves * outside)
            begin, out = 0, []
            for cut in np.flatnonzero(comma & outside & (level == 1)).tolist():
                out.append((pos, piece, fresh, raw[begin:cut].tobytes().decode()))
                begin, pos, piece, fresh = cut + 1, pos + 1, 0, True
            if begin < len(raw):
                out.append((pos, piece, False, raw[begin:].tobytes().decode()))
                piece, fresh = piece + 1, False
            turns, depth = (turns + int(quotes[-1])) % 2, int(level[-1])
            n = len(out)
            if n:
                places, pieces, whole, texts = zip(*out)
                columns = [np.full(n, key[0]), np.array(places), np.full(n, key[1]), np.array(pieces), np.array(whole), np.array(places) == last]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.string())], _names(PIECES))

    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, text) of every element of the JSON array in each file of ``path``; ``part`` is the path of the file.

    ``text`` is the element as written, with blanks around it. Fails on a file
    that is not one JSON array.
    """
    return _elements(spark, path, r"\[", r"\]")


def object_members(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, text) of every member, ``"key": value``, of the JSON object in each file."""
    return _elements(spark, path, r"\{", r"\}")


def _elements(spark: SparkSession, path: str, opening: str, closing: str) -> DataFrame:
    records = _records(spark, path)
    # A row for each split of the inputs.
    entries = range_entries(records).collect()
    if any(e["faulty"] for e in entries):
        raise ValueError(f"not one JSON value in each file: {path}")
    cut = _cutter({(e["file"], e["block"]): (e["inside"], e["depth"], e["pos"], e["last"]) for e in entries})
    pieces = records.mapInArrow(cut, PIECES)
    whole = pieces.where("whole").select("file", "pos", "text")
    # The first and last element of a file, and those cut by a border of ranges or portions.
    part = F.struct("block", "piece", "text")
    joined = F.array_join(F.sort_array(F.collect_list(part))["text"], "")
    parts = pieces.where("not whole").groupBy("file", "pos").agg(joined.alias("text"), F.bool_or("last").alias("last"))
    found = whole.unionByName(_without_brackets(parts, opening, closing))
    return found.join(F.broadcast(_files(spark, path)), "file").select("part", "pos", "text")


def _without_brackets(parts: DataFrame, opening: str, closing: str) -> DataFrame:
    """The first element without the bracket before it, the last without the one after it and the comma added there."""
    text = F.when(F.col("pos") == 0, _stripped(F.col("text"), rf"^\s*{opening}")).otherwise(F.col("text"))
    text = F.when(F.col("last"), _stripped(text, rf"{closing}\s*,?\s*$")).otherwise(text)
    # An empty array has one element of blanks.
    empty = (F.col("pos") == 0) & F.col("last") & ~F.rlike("text", F.lit(r"\S"))
    return parts.withColumn("text", text).where(~empty).select("file", "pos", "text")


def _stripped(text: F.Column, pattern: str) -> F.Column:
    wrong = F.raise_error(F.lit("not one JSON value of the expected kind")).cast("string")
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_replace(text, pattern, "")).otherwise(wrong)
