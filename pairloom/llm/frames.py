"""What the operators share: session settings, inputs, groups of sorted rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from pairloom.operators.bloom import Sieve

# Rows differ from a few bytes to a long text: bytes, not rows, bound a batch.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "100000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: others can not clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 1_000_000


def small_or_dealt(stored_rows: DataFrame) -> DataFrame:
    """A stored table of few narrow columns for a join: broadcast up to a counted number of rows, else joined by a shuffle."""
    return F.broadcast(stored_rows) if stored_rows.count() <= BROADCAST_ROWS else stored_rows


def matching(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """An inner join of long rows with a stored table of narrow ones by a long key.

    Beyond a broadcast only rows that pass a Bloom filter are shuffled.
    """
    count = few.count()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key)
    return Sieve(few, [key], count).may_match(rows).join(few, key)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key, not null, is not in a stored table of long keys. ``rows`` is read twice where keys are too many for a broadcast."""
    count = gone.count()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), key, "left_anti").select(*rows.columns)
    # The filter hashes a key as it is: of another type it has another hash.
    sieve = Sieve(gone, [key], count) if rows.schema[key].dataType == LongType() else None
    if sieve is None or not sieve.useful:
        return rows.join(gone, key, "left_anti").select(*rows.columns)
    return sieve.surely_not(rows).unionByName(sieve.may_match(rows).join(gone, key, "left_anti").select(*rows.columns))


def most_frequent(rows: DataFrame, count_col: str, keep: int) -> DataFrame:
    """The rows of the highest counts, at most ``keep``: all rows above a cut between count bands.

    The cut comes from a histogram of some hundred bands, so no task sorts or
    merges the rows themselves. Rows of one band stay or go together.
    """
    band = F.floor(F.log2(F.col(count_col)) * 16)
    bands = sorted(rows.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"])
    total, cut = 0, None
    for r in bands:
        total += r["count"]
        if total > keep:
            break
        cut = r["band"]
    return rows.where(F.lit(False) if cut is None else band >= cut)


def mapped(df: DataFrame, schema: str, run) -> DataFrame:
    """``mapInArrow`` with one function from a record batch to a dict of columns, or to none."""
    names = [field.split()[0] for field in _fields(schema)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = run(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names], names)

    return df.mapInArrow(over, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, last = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(last.strip())
            last = ""
        else:
            last += c
    return [*out, last.strip()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in ``keys``, from batches sorted by them. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def int_lists(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.Array:
    """A list column from one flat array and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))
