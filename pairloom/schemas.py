"""Declared schemas. Nothing here is ever inferred from data."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FILE_LIST = _strings("repository_full_name", "file_path", "download_url")

CODE_FILES = T.StructType(
    [
        T.StructField("repository_full_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_pos", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)

# One row per function of a file. A file without functions keeps one row whose
# `name` is null, so that its parse status (and its repository) is not lost.
PARSED = T.StructType(
    [
        T.StructField("fn_pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("parse_status", T.StringType()),
    ]
)

FUNCTION_PAIRS = _strings(
    "function_name",
    "function_code",
    "function_file",
    "test_function_name",
    "test_function_code",
    "test_function_file",
    "repository",
)

DATA_PAIRS = _strings("input_code", "test_code", "repo_name", "code_file", "test_file")

REPO_LEDGER = _strings("repository_full_name")

FILE_LEDGER = _strings("repository_full_name", "file_path")

REPO_STATS = T.StructType(
    [
        T.StructField("repository", T.StringType()),
        T.StructField("num_pairs", T.LongType()),
    ]
)

COVERAGE = T.StructType(
    [
        T.StructField("TargetModule", T.StringType()),
        T.StructField("Coverage", T.DoubleType()),
    ]
)

# Where a record stands in its inputs: the rank of the input, the part file,
# the byte block inside that file, the record inside that block. Compares
# left to right, so "first" and "last" are min_by / max_by on one column.
ORD = T.StructType(
    [
        T.StructField("file_ord", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)

# Fixed values.
TEST_PREFIX = "test_"
INSTRUCTION = "为以下 Python 函数编写对应的单元测试代码。"
UNNAMED_FUNCTION = "未知函数"
