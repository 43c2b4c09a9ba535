"""JSON arrays, JSON Lines and parquet, read with explicit positions."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairloom.operators.validate import split_valid_items
from pairloom.schemas import FUNCTION_PAIRS, ORD
from pairloom.sources.json_arrays import array_elements


def _ord(file_ord: int, path: Column, block: Column, pos: Column) -> Column:
    """Part files compare by folder, then by part number, then by name: numbers grow longer from 100,000 parts on."""
    folder = F.regexp_extract(path, r"^(.*/)?", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    number = F.lpad(F.regexp_extract(name, r"^part-([0-9]+)", 1), 20, "0")
    return F.struct(F.lit(file_ord), F.concat(folder, number, name), block, pos).cast(ORD).alias("ord")


def array_items(texts: DataFrame, value: str = "value") -> DataFrame:
    """One row per element of the JSON array in each row: ``pos`` and the element as VARIANT.

    Outer, then filtered: the check for an empty array that Catalyst infers
    from an inner explode would parse every text twice.
    """
    others = [c for c in texts.columns if c != value]
    # Element by element: one variant of the whole array would be limited to 128 MiB.
    elements = F.from_json(F.col(value), "array<variant>", {"mode": "FAILFAST"})
    return texts.select(*others, F.posexplode_outer(elements).alias("pos", "item")).where("pos is not null")


def read_items(spark: SparkSession, path: str, fmt: str = "jsonl", file_ord: int = 0) -> DataFrame:
    """Raw records (``ord``, ``item`` VARIANT) of one input.

    ``json`` is one array per file, ``jsonl`` a record per line. Large files
    of both are split between tasks; an array is read twice.
    """
    meta = F.col("_metadata")
    if fmt == "json":
        elements = array_elements(spark, path)
        return elements.select(_ord(file_ord, F.col("part"), F.lit(0), F.col("pos")), F.parse_json("text").alias("item"))
    if fmt == "jsonl":
        # Rows of a block are read in line order by one task, so a growing id orders them.
        return (
            spark.read.text(path)
            .where(F.rlike("value", F.lit(r"\S")))
            .select(
                _ord(file_ord, meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id()),
                F.parse_json("value").alias("item"),
            )
        )
    raise ValueError(f"unknown format: {fmt}")


def typed(items: DataFrame, schema: T.StructType) -> DataFrame:
    """Members named in ``schema`` as columns; a missing one is null."""
    return items.select(
        "ord",
        *(F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields),
    )


def read_file_list(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Usable entries of a file list; ``file_pos`` is the place in the array (JSON Lines: use ``ord``)."""
    good, _ = split_valid_items(read_items(spark, path, fmt))
    if fmt == "json":
        return good.withColumn("file_pos", F.col("ord.pos")).drop("ord")
    return good


def read_pairs(
    spark: SparkSession, paths: Sequence[str], fmt: str = "jsonl", schema: T.StructType = FUNCTION_PAIRS
) -> DataFrame:
    """Pair files one after the other, in the order given."""
    parts = [_read_pairs(spark, path, fmt, i, schema) for i, path in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_pairs(spark, path, fmt, file_ord, schema):
    if fmt == "parquet":
        meta = F.col("_metadata")
        place = _ord(file_ord, meta["file_path"], F.lit(0), meta["row_index"])
        return spark.read.schema(schema).parquet(path).select(place, *schema.fieldNames())
    return typed(read_items(spark, path, fmt, file_ord), schema)
