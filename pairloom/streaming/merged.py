"""Keep-first over pair sets that arrive in any order, one merge at a time.

The merged set lies in buckets by the hash of its keys. A merge reads and
writes only the buckets that its rows fall into, and what decides is the order
of the records, not of their arrival: a later merge with an earlier record
replaces the row that was there.

Folders: ``rows/batch_id=N/bucket=B`` with the whole new state of bucket B, and
``log/batch_id=N`` with the buckets of a finished merge, written last. The
state of a bucket is that of the last merge in the log that has it, so a merge
that died is not seen, and is repeated under its number. Nothing is rewritten
in place. Folders of states that a later merge replaced can be removed once no
reader uses them: ``replaced`` lists them. One merge at a time.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairloom.operators.curate import keep_first
from pairloom.session import stored
from pairloom.sources.state import read_table

BUCKETS = 64
_BATCH, _BUCKET = T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())
LOG = T.StructType([_BUCKET, _BATCH])


class MergedSet:
    """A merged set of rows with one schema. Null is a key like any other."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str] = ("function_name",),
        order: Sequence[str] = ("ord",),
        buckets: int = BUCKETS,
    ) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.order, self.buckets = list(keys), list(order), buckets

    def log(self) -> DataFrame:
        """(bucket, batch_id) of all finished merges."""
        return read_table(self.spark, f"{self.path}/log", LOG)

    def _current(self) -> dict[int, int]:
        """The merge that holds the state of each bucket: at most as many entries as buckets."""
        return {r["bucket"]: r["batch_id"] for r in self.log().groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()}

    def _state(self, holders: dict[int, int]) -> DataFrame:
        """Rows of some buckets. Only their folders are read."""
        rows = read_table(self.spark, f"{self.path}/rows", T.StructType([*self.schema.fields, _BATCH, _BUCKET]))
        buckets_of: dict[int, list[int]] = {}
        for bucket, batch in holders.items():
            buckets_of.setdefault(batch, []).append(bucket)
        any_of = [(F.col("batch_id") == batch) & F.col("bucket").isin(some) for batch, some in buckets_of.items()]
        return rows.where(reduce(Column.__or__, any_of, F.lit(False))).select(*self.schema.fieldNames())

    def rows(self) -> DataFrame:
        return self._state(self._current())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame) -> int | None:
        """Merge rows into the set; the number of the merge, None if there are no rows."""
        names = self.schema.fieldNames()
        first = keep_first(rows.select(*names), self.keys, self.order)
        new = stored(first.withColumn("bucket", self._bucket()), "arrived")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return None
        log = self.log().agg(F.max("batch_id")).first()[0]
        batch = 0 if log is None else log + 1
        held = {b: n for b, n in self._current().items() if b in set(touched)}
        state = keep_first(new.select(*names).unionByName(self._state(held)), self.keys, self.order)
        # A file for each bucket: its rows meet in one task, as many as fit a bucket.
        dealt = state.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch_id={batch}")
        done = self.spark.createDataFrame([(b,) for b in touched], T.StructType([_BUCKET]))
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch}")
        return batch

    def replaced(self) -> DataFrame:
        """(batch_id, bucket, folder) of states that a later merge replaced."""
        last = self.log().groupBy("bucket").agg(F.max("batch_id").alias("_last"))
        old = self.log().join(last, "bucket").where("batch_id < _last")
        folder = F.format_string(f"{self.path}/rows/batch_id=%d/bucket=%d", "batch_id", "bucket")
        return old.select("batch_id", "bucket", folder.alias("folder"))
