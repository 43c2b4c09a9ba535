"""Counts per repository and per run."""

from pyspark.sql import DataFrame, functions as F


def files_by_repo(files: DataFrame) -> DataFrame:
    """Listed files per repository. The groups themselves are never collected: the repository stays a key."""
    return files.groupBy("repository_full_name").agg(
        F.count("*").alias("num_files"),
        F.min("file_pos").alias("first_pos"),
        F.max("file_pos").alias("last_pos"),
    )


def pairs_per_repo(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("repository").agg(F.count("*").alias("num_pairs"))


def repo_stats(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per repository, zero for a repository with files but no pair.

    A repository adds a zero and every pair a one, so one aggregate replaces
    a distinct, a count and an outer join.
    """
    listed = files.select(F.col("repository_full_name").alias("repository"), F.lit(0).cast("long").alias("n"))
    found = pairs.select("repository", F.lit(1).cast("long").alias("n"))
    return listed.unionByName(found).groupBy("repository").agg(F.sum("n").alias("num_pairs"))


def run_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("repos_done"),
        F.count_if(F.col("num_pairs") > 0).alias("repos_with_pairs"),
        F.coalesce(F.sum("num_pairs"), F.lit(0).cast("long")).alias("total_pairs"),
        F.max("num_pairs").alias("most_pairs"),
    )
