"""Merge pair sets and reshape them into tuning records."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.winners import numbered, ordered_like_records, winners, with_record_order
from pairloom.schemas import INSTRUCTION, UNNAMED_FUNCTION


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the parts; a part may lack columns others have."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def keep_first(rows: DataFrame, keys: Sequence[str] = ("function_name",), order: Sequence[str] = ("ord",)) -> DataFrame:
    """The first row of each key, over all inputs and repositories. Null is a key like any other.

    Rows are stored with numbers; keys and places alone find the first one of
    each key, so codes and texts of the others are neither sorted nor moved.
    Callers sort at the sink.
    """
    missing = [c for c in (*keys, *order) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing from the rows to merge: {missing}")
    names = rows.columns
    rows = numbered(rows, "merged")
    if ordered_like_records(rows, order):
        return winners(with_record_order(rows), keys, F.col("_order"), last=False).select(*names)
    return winners(rows, keys, F.struct(*order), last=False).select(*names)


def _member(item: str, key: str) -> Column:
    return F.try_variant_get(F.col(item), f"$.{key}", "variant")


def has_key(item: str, key: str) -> Column:
    """Whether an object has a key; a key with a JSON null counts."""
    return _member(item, key).isNotNull()


def text_of(item: str, key: str) -> Column:
    return F.try_variant_get(F.col(item), f"$.{key}", "string")


def strict_text_of(item: str, key: str) -> Column:
    """The text under a key; the job fails where the key is missing."""
    return F.when(has_key(item, key), text_of(item, key)).otherwise(
        F.raise_error(F.lit(f"missing key: {key}")).cast("string")
    )


def input_output(pairs: DataFrame) -> DataFrame:
    """Records `{input, output}` from typed pairs; a missing column fails at planning."""
    return pairs.select(F.col("function_code").alias("input"), F.col("test_function_code").alias("output"))


def input_output_items(items: DataFrame, item: str = "item") -> DataFrame:
    """The same from raw items; a missing key fails the job."""
    return items.select(
        strict_text_of(item, "function_code").alias("input"),
        strict_text_of(item, "test_function_code").alias("output"),
    )


def _complete(item: str) -> Column:
    return has_key(item, "function_code") & has_key(item, "test_function_code")


def instruction_records(items: DataFrame, item: str = "item", instruction: str = INSTRUCTION, keep: Sequence[str] = ()) -> DataFrame:
    """Records `{instruction, input, output}` from raw items that have both codes, be they null."""
    return items.where(_complete(item)).select(
        *keep,
        F.lit(instruction).alias("instruction"),
        text_of(item, "function_code").alias("input"),
        text_of(item, "test_function_code").alias("output"),
    )


def skipped_items(items: DataFrame, item: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """Names of the items ``instruction_records`` leaves out."""
    name = F.when(has_key(item, "function_name"), text_of(item, "function_name")).otherwise(UNNAMED_FUNCTION)
    return items.where(~_complete(item)).select(*keep, name.alias("function_name"))


def instruction_counts(item: str = "item") -> list[Column]:
    """Aggregates for ``agg`` or ``observe``: items that become records, and items left out."""
    return [
        F.count_if(_complete(item)).alias("converted"),
        F.count_if(~_complete(item)).alias("skipped"),
    ]
