"""Merge pair files, drop repeated names, write tuning records."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pairloom.operators.curate import (
    concatenate,
    input_output,
    input_output_items,
    instruction_counts,
    instruction_records,
    keep_first,
    strict_text_of,
)
from pairloom.session import stored
from pairloom.sinks.tables import write_jsonl, write_splits
from pairloom.sources.items import read_items, read_pairs


def merge_pair_files(spark: SparkSession, paths: Sequence[str], fmt: str = "jsonl") -> DataFrame:
    """First pair of every function name, in file and line order; ``ord`` is kept for the sink.

    Typed columns can not tell an absent name from a null one; jobs over raw
    files use ``merge_items``.
    """
    return keep_first(read_pairs(spark, paths, fmt))


def raw_items(spark: SparkSession, paths: Sequence[str], fmt: str = "jsonl") -> DataFrame:
    return concatenate([read_items(spark, p, fmt, i) for i, p in enumerate(paths)])


def merge_items(spark: SparkSession, paths: Sequence[str], fmt: str = "jsonl") -> DataFrame:
    """First raw item of every function name. An item without that key fails the job; a null name is one name."""
    items = raw_items(spark, paths, fmt)
    return keep_first(items.withColumn("function_name", strict_text_of("item", "function_name")))


def write_item_splits(spark: SparkSession, paths: Sequence[str], out: str, n: int, fmt: str = "jsonl") -> None:
    """The raw items of the files in file order, as shards ``split=1`` .. ``split=n`` of JSON Lines."""
    lines = stored(raw_items(spark, paths, fmt).select("ord", F.to_json("item").alias("value")), "items")
    write_splits(lines, out, ["ord"], n, "text", ["value"])


def write_input_output(spark: SparkSession, paths: Sequence[str], out: str, fmt: str = "jsonl") -> None:
    """Two-field records of merged pairs; a missing name or code fails the job."""
    if fmt == "parquet":
        records = input_output(merge_pair_files(spark, paths, fmt).orderBy("ord"))
    else:
        records = input_output_items(merge_items(spark, paths, fmt).orderBy("ord"))
    write_jsonl(records, out)


def write_instructions(
    spark: SparkSession, paths: Sequence[str], out: str, fmt: str = "jsonl", merge: bool = True
) -> dict[str, int]:
    """From raw items, so that a null code counts as present and an absent one as missing.

    With ``merge`` the first item of every name is used and all need a name;
    without it every item is, named or not. Returns how many items were
    converted and skipped, counted by the job that writes.
    """
    items = (merge_items if merge else raw_items)(spark, paths, fmt)
    counts = Observation()
    counted = items.orderBy("ord").observe(counts, *instruction_counts())
    write_jsonl(instruction_records(counted), out)
    return counts.get
