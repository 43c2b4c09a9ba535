"""Which list items, files and test files take part."""

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.names import is_source_file


def require_rows(df: DataFrame, what: str = "the file list") -> DataFrame:
    """Fail before any job starts on an empty input. Reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def _named(repo: str | Column) -> Column:
    repo = F.col(repo) if isinstance(repo, str) else repo
    return F.coalesce(repo != "", F.lit(False))


def split_valid_items(items: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) file-list items, from a VARIANT column of raw items.

    An item is rejected when it is not an object or has no repository name.
    The usable side has the file-list columns, the rejected side a reason.
    """
    v = F.col(item)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    # A name that is not a string can not be a repository: read it as text all the same.
    repo = F.try_variant_get(v, "$.repository_full_name", "string")
    others = [c for c in items.columns if c != item]
    good = items.where(is_object & _named(repo)).select(
        *others,
        repo.alias("repository_full_name"),
        F.try_variant_get(v, "$.file_path", "string").alias("file_path"),
        F.try_variant_get(v, "$.download_url", "string").alias("download_url"),
    )
    bad = items.where(~(is_object & _named(repo))).select(
        *others,
        F.to_json(v).alias("item_json"),
        F.when(is_object, "no repository").otherwise("not an object").alias("reason"),
    )
    return good, bad


def has_repository() -> Column:
    return _named("repository_full_name")


def valid_files(files: DataFrame) -> DataFrame:
    """Typed form of the same rule."""
    return files.where(has_repository())


def rejected_files(files: DataFrame) -> DataFrame:
    return files.where(~has_repository())


def with_content(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNotNull() & (F.col("content") != ""))


def source_files(files: DataFrame) -> DataFrame:
    return files.where(is_source_file("file_path"))

