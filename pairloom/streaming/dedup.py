"""Keep-first on a stream. First means first to arrive, not first in file order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def keep_first_arrival(rows: DataFrame, keys: Sequence[str] = ("function_name",)) -> DataFrame:
    """State is one entry per key, held in RocksDB, so it may exceed executor memory."""
    return rows.dropDuplicates(list(keys))


def start_dedup(spark: SparkSession, landing: str, schema: T.StructType, out: str, keys: Sequence[str] = ("function_name",)) -> StreamingQuery:
    rows = spark.readStream.schema(schema).parquet(landing)
    return (
        keep_first_arrival(rows, keys)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/_dedup")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
