"""What earlier runs left behind. Absent state reads as empty."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairloom.functions.text import stripped
from pairloom.schemas import FILE_LEDGER, FUNCTION_PAIRS, REPO_LEDGER, REPO_STATS
from pairloom.sources.json_arrays import array_elements, object_members


def or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """``read()``, or an empty table when its path does not exist. Other failures stay failures."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = REPO_LEDGER) -> DataFrame:
    return read_table(spark, path, schema)


def read_pairs_or_empty(spark: SparkSession, path: str, schema: T.StructType = FUNCTION_PAIRS) -> DataFrame:
    return read_table(spark, path, schema)


def read_json_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of repository names."""

    def read():
        name = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
        return array_elements(spark, path).select(F.explode(name).alias("repository_full_name"))

    return or_empty(spark, read, REPO_LEDGER)


def read_log_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A log of ``repo:path`` lines."""
    line = stripped(F.col("value"))
    return or_empty(
        spark,
        lambda: spark.read.text(path)
        .select(
            F.regexp_extract(line, "^([^:]*):", 1).alias("repository_full_name"),
            F.regexp_extract(line, "^[^:]*:(.*)$", 1).alias("file_path"),
        )
        .where("repository_full_name <> ''")
        .distinct(),
        FILE_LEDGER,
    )


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects, one in each file, repository to number of pairs, as rows. A large file is read by many tasks."""

    def read():
        entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,bigint>")
        return object_members(spark, path).select(F.explode(entry).alias("repository", "num_pairs"))

    return or_empty(spark, read, REPO_STATS)
