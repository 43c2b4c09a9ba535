"""Contents and lists in buckets of one layout: they are joined where they lie.

Landed contents are wide and are joined with every list that is mined. Written
once in buckets by file, they meet a list in the same buckets without being
shuffled or sorted. A file is one key, so a repository with a third of all
files fills no bucket more than another.
"""

from pyspark.sql import DataFrame, SparkSession

FILE = ["repository_full_name", "file_path"]
BUCKETS = 200


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Write a table of files to a folder in buckets, under a name of the session catalog. One file for each bucket."""
    dealt = df.repartition(buckets, *FILE)
    dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, *FILE).saveAsTable(table)


def attach_bucketed_content(spark: SparkSession, list_table: str, contents_table: str) -> DataFrame:
    """The content of each listed file, from two tables with the same buckets; no content leaves its bucket.

    A task holds the names of one bucket of the list in a hash table and
    streams the contents of that bucket past it.
    """
    listed = spark.table(list_table).hint("shuffle_hash")
    return spark.table(contents_table).select(*FILE, "content").join(listed, FILE)
