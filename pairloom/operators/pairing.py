"""Pair ``test_<name>`` with ``<name>`` inside one repository.

Mode B works over listed files and takes the *last* function of a name.
Mode A works per test file over all source files and takes the function from
the *first* file, in tree order, that has the name.
"""

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.names import tree_order
from pairloom.operators.joins import skewed_lookup
from pairloom.operators.winners import ROW, fetched, file_order, last_row, numbered, winners
from pairloom.schemas import FUNCTION_PAIRS
from pairloom.session import stored

KEYS = ["repository_full_name", "base_name"]


def _both_sides(functions: DataFrame) -> DataFrame:
    """Per (repository, base name): the numbers of the last test and the last function, either may be null.

    One exchange does the work of two collapses and a join. The key spreads a
    large repository over all reducers, and the partial aggregate leaves one
    row per key and map task however often a name occurs.
    """
    order, is_test = file_order(), F.col("is_test")
    return functions.groupBy(*KEYS).agg(last_row(order, is_test).alias("_test"), last_row(order, ~is_test).alias("_function"))


def pair_listed(functions: DataFrame) -> DataFrame:
    """Mode B pairs.

    Functions are stored with numbers; names and places alone give the numbers
    of each pair. Only code that is in a pair is shuffled, once, to bring its
    two sides together.
    """
    functions = numbered(functions, "functions")
    found = _both_sides(functions).where("_test is not null and _function is not null")
    pairs = stored(found.select("_test", "_function"), "pairs")
    f = functions.where("not is_test").select(
        ROW,
        F.col("name").alias("function_name"),
        F.col("code").alias("function_code"),
        F.col("file_path").alias("function_file"),
    )
    t = functions.where("is_test").select(
        ROW,
        F.col("name").alias("test_function_name"),
        F.col("code").alias("test_function_code"),
        F.col("file_path").alias("test_function_file"),
        F.col("repository_full_name").alias("repository"),
    )
    return fetched(pairs, "_function", f).join(fetched(pairs.select("_test"), "_test", t), "_test").select(*FUNCTION_PAIRS.fieldNames())


def unmatched_listed(functions: DataFrame) -> DataFrame:
    """Tests of mode B without a function. No code is stored or shuffled."""
    functions = numbered(functions.select(*KEYS, "is_test", "file_pos", "fn_pos", "name", "file_path"), "names")
    alone = stored(_both_sides(functions).where("_test is not null and _function is null").select("_test"), "alone")
    return fetched(alone, "_test", functions).select(
        F.col("repository_full_name").alias("repository"),
        F.col("name").alias("test_function_name"),
        F.col("file_path").alias("test_function_file"),
    )


def first_candidates(functions: DataFrame) -> DataFrame:
    """Per (repository, name) the function of the first file in tree order; in that file the last one.

    Names of candidates are free: one may itself start with ``test_``.
    """
    rows = numbered(functions.withColumn("base_name", F.col("name")), "candidates")
    place = F.struct(tree_order("file_path").alias("file"), (-F.col("fn_pos")).alias("back"))
    return winners(rows, KEYS, place, last=False).select(*KEYS, F.struct("code", "file_path").alias("f"))


def pair_by_test_file(tests: DataFrame, functions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Mode A pairs. ``hot`` is an optional list of heavy keys, see ``joins.heavy_keys``."""
    t = tests.select(*KEYS, F.col("code").alias("test_code"), F.col("file_path").alias("test_file"))
    return skewed_lookup(t, first_candidates(functions), KEYS, hot).select(
        F.col("f.code").alias("input_code"),
        "test_code",
        F.col("repository_full_name").alias("repo_name"),
        F.col("f.file_path").alias("code_file"),
        "test_file",
    )


def unmatched_by_test_file(tests: DataFrame, functions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Mode A tests whose function no source file has. Needs names only."""
    t = tests.select(*KEYS, F.col("file_path").alias("test_file"), F.col("name").alias("test_function_name"))
    known = functions.select("repository_full_name", F.col("name").alias("base_name")).distinct()
    return skewed_lookup(t, known, KEYS, hot, how="left_anti").select(
        F.col("repository_full_name").alias("repo_name"), "test_file", "test_function_name"
    )
