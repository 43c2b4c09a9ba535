"""The two mining jobs."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from pairloom.operators.extract import extract_functions, files_with_tests, extract_tests
from pairloom.operators.joins import attach_content, heavy_keys, keep_known, narrow_to, skip_known
from pairloom.operators.pairing import KEYS, pair_by_test_file, pair_listed, unmatched_by_test_file
from pairloom.operators.stats import repo_stats
from pairloom.operators.validate import source_files, valid_files
from pairloom.operators.winners import numbered
from pairloom.session import stored

REPO = ["repository_full_name"]
FILE = ["repository_full_name", "file_path"]


class Mined(NamedTuple):
    pairs: DataFrame
    done: DataFrame  # ledger rows of this run
    stats: DataFrame | None = None
    unmatched: DataFrame | None = None  # tests without a function


def mine_listed(file_list: DataFrame, contents: DataFrame, ledger: DataFrame) -> Mined:
    """Mode B: pairs inside the listed files of every repository that is not in the ledger.

    Of a file listed more than once the last place counts, as its functions
    would overwrite themselves. The list and the pairs are stored, so every
    file is parsed once however many of the tables are used.
    """
    listed = skip_known(valid_files(file_list), ledger, REPO)
    todo = stored(listed.groupBy(*FILE).agg(F.max("file_pos").alias("file_pos")), "listed")
    pairs = stored(pair_listed(extract_functions(attach_content(todo, contents), last_only=True)), "pairs")
    return Mined(pairs, todo.select(*REPO).distinct(), repo_stats(todo, pairs))


def mine_by_test_file(
    file_list: DataFrame, contents: DataFrame, ledger: DataFrame, keep_duplicates: bool = False
) -> Mined:
    """Mode A: each listed test file against all source files of its repository.

    Tests are stored once: they are read for the heavy keys, the pairs, the
    unmatched tests and the ledger; so are the candidates that a test asks for,
    with the numbers by which the code of the winners is found.
    Only source files of repositories with tests are parsed.
    """
    listed = skip_known(valid_files(file_list), ledger, FILE).select(*FILE)
    listed = stored(listed if keep_duplicates else listed.distinct(), "listed")
    tests = stored(extract_tests(attach_content(listed, contents)), "tests")
    sources = keep_known(source_files(contents), tests.select(*REPO).distinct(), REPO)
    # In-file winners only: names repeat across files, not within one.
    candidates = extract_functions(sources.select(*FILE, "content"), last_only=True)
    # Only functions that a test asks for need to be shuffled with their code.
    asked = stored(tests.select("repository_full_name", F.col("base_name").alias("name")).distinct(), "asked")
    candidates = numbered(narrow_to(candidates, asked, ["repository_full_name", "name"]), "candidates")
    hot = heavy_keys(tests, KEYS)
    return Mined(
        pair_by_test_file(tests, candidates, hot),
        files_with_tests(tests),
        unmatched=unmatched_by_test_file(tests, candidates, hot),
    )
