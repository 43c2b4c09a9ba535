"""Datasets, JSON Lines, ledgers and shards."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pairloom.operators.split import assign_split, shard_size


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet or JSON Lines, in ``order`` if given: part file names and rows then follow it."""
    out = df.orderBy(*order) if order else df
    out.write.mode(mode).option("ignoreNullFields", "false").format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One JSON object per line, keys in column order, nulls kept, text not escaped."""
    write_dataset(df, path, "json", order, mode)


def append_ledger(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Adds part files; what is there is not read or rewritten."""
    pairs.write.mode("append").parquet(path)


def write_splits(
    df: DataFrame, path: str, order: Sequence[str], n: int, fmt: str = "json", keep: Sequence[str] | None = None
) -> None:
    """Shards ``split=1`` .. ``split=n``, each in order, of the columns ``keep`` or all. Shards past the last row exist and are empty."""
    keep = list(keep or df.columns)
    placed = assign_split(df, order, n)
    sorted_rows = placed.repartitionByRange("split", *order).sortWithinPartitions("split", *order)
    sorted_rows.select(*keep, "split").write.option("ignoreNullFields", "false").partitionBy("split").format(fmt).save(path)
    total = df.count()
    filled = -(-total // shard_size(total, n)) if total else 0
    for i in range(filled + 1, n + 1):
        df.limit(0).select(*keep).write.format(fmt).save(f"{path}/split={i}")
