"""Predicates and keys over function names and file paths."""

from pyspark.sql import Column, functions as F

from pairloom.schemas import TEST_PREFIX


def is_test(name: str | Column) -> Column:
    return F.startswith(_col(name), F.lit(TEST_PREFIX))


def base_name(name: str | Column) -> Column:
    """The name of the function a test is for. ``test_`` alone gives ``''``, which no function has."""
    return F.substring(_col(name), len(TEST_PREFIX) + 1, 2**31 - 1)


def is_source_file(path: str | Column) -> Column:
    """Ends in ``.py`` and has no ``test`` anywhere in the path, whatever its case."""
    return F.endswith(_col(path), F.lit(".py")) & ~F.contains(F.lower(_col(path)), F.lit("test"))


def tree_order(path: str | Column) -> Column:
    """Sorts paths like a breadth-first walk over name-sorted folders."""
    parts = F.split(_col(path), "/")
    return F.struct(F.size(parts).alias("depth"), parts.alias("parts"))


def file_key(repo: str | Column, path: str | Column) -> Column:
    return F.concat_ws(":", _col(repo), _col(path))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
