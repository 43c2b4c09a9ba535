"""File contents that have landed in storage."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import decode_text, utf8_ignoring_errors
from pairloom.schemas import CODE_FILES, COVERAGE


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of files."""
    return spark.read.schema(CODE_FILES).parquet(path)


def read_checkouts(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """A folder of checkouts, ``<root>/<owner>/<repo>/<file path>``. Bytes that are not UTF-8 are dropped."""
    where = rf"{_literal(root)}/+([^/]+/[^/]+)/(.*)$"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.withColumn("content", F.col("content").cast("string")).select(
        F.regexp_extract("path", where, 1).alias("repository_full_name"),
        F.regexp_extract("path", where, 2).alias("file_path"),
        utf8_ignoring_errors(F.col("content")).alias("content"),
    )


def decode_files(files: DataFrame, encoded: str = "content_b64") -> DataFrame:
    """Base64 contents, as a contents API delivers them, to text."""
    return decode_text(files, encoded, "content")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COVERAGE).csv(path, header=True)


def _literal(root: str) -> str:
    return "\\Q" + root.rstrip("/").removeprefix("file:") + "\\E"
