"""Files to functions.

Parsing is narrow: it runs where the file was read, and only functions are
ever shuffled. Filter files *before* extraction; predicates on the columns of
the file itself are pushed below the parser by Catalyst, and only `content`
crosses to Python.
"""

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.names import base_name, is_test
from pairloom.functions.python_source import functions_of, last_functions_of
from pairloom.functions.text import utf8_ignoring_errors
from pairloom.operators.validate import with_content
from pairloom.operators.winners import file_order, winners


def parse_files(files: DataFrame, last_only: bool = False, keep_empty: bool = False) -> DataFrame:
    """One row per function and one nameless row per file without any; keeps the other columns.

    ``last_only`` applies the in-file rule "the last function of a name wins"
    without a shuffle. Files without content are left out; with ``keep_empty``
    they have a nameless row of status ``empty``, so that their repository is
    not lost. Bytes that are not UTF-8 are dropped.
    """
    parse = last_functions_of if last_only else functions_of
    kept = [c for c in files.columns if c != "content"]
    found = parse(utf8_ignoring_errors(F.col("content")))
    if not keep_empty:
        return with_content(files).select(*kept, F.inline(found))
    filled = F.coalesce(F.col("content") != "", F.lit(False))
    rows = files.select(*kept, filled.alias("_filled"), F.inline_outer(found))
    status = F.when(F.col("_filled"), F.col("parse_status")).otherwise("empty")
    return rows.withColumn("parse_status", status).drop("_filled")


def named_functions(parsed: DataFrame) -> DataFrame:
    """Drop nameless rows, split tests from functions."""
    test = is_test("name")
    return (
        parsed.where(F.col("name").isNotNull())
        .drop("parse_status")
        .withColumns({"is_test": test, "base_name": F.when(test, base_name("name")).otherwise(F.col("name"))})
    )


def extract_functions(files: DataFrame, last_only: bool = False) -> DataFrame:
    return named_functions(parse_files(files, last_only))


def extract_tests(test_files: DataFrame) -> DataFrame:
    """The tests of listed test files, one per name and file."""
    return extract_functions(test_files, last_only=True).where("is_test")


def files_with_tests(tests: DataFrame) -> DataFrame:
    """Test files that have at least one test: the only ones a run may mark as done."""
    return tests.select("repository_full_name", "file_path").distinct()


def parse_report(parsed: DataFrame) -> DataFrame:
    """Files and functions per parse status; every file has exactly one first row."""
    first = F.col("fn_pos").isNull() | (F.col("fn_pos") == 0)
    return parsed.groupBy("parse_status").agg(
        F.count_if(first).alias("num_files"),
        F.count("name").alias("num_functions"),
    )


def collapse_in_file(functions: DataFrame) -> DataFrame:
    """Last function of each name in a file, from functions already stored as rows."""
    found = winners(functions, ["repository_full_name", "file_path", "name"], F.col("fn_pos"), label="functions")
    return found.select("repository_full_name", "file_path", "name", "fn_pos", "code")


def collapse_across_files(functions: DataFrame) -> DataFrame:
    """Last function of each name in a repository, in list order then in-file order."""
    found = winners(functions, ["repository_full_name", "name"], file_order(), label="functions")
    return found.select("repository_full_name", "name", "file_path", "file_pos", "fn_pos", "code")
