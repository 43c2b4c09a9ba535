"""Resumable mining: parse new files as a stream, pair new repositories in numbered batches.

Parsing is the costly, stateless part: a file stream with a checkpoint, whose
file sink shows each parsed file exactly once. Pairing needs all files of a
repository, so it runs as a batch over repositories that are not done. A
batch overwrites folders named after its number, and the ledger is written
last: a run that died before that is repeated under the same number.

Parsed rows carry the number of the batch they arrived for, as a partition,
and are written once. A repository that waits for files is remembered by the
names of those that came and the batches they came in; when it is complete,
only those partitions are read. So the work of a run grows with what is new
and not with what was mined before. The waiting files are a table and not
keyed stream state, as that would move all code of a repository to one task.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.extract import extract_functions, named_functions, parse_files
from pairloom.operators.joins import attach_content, keep_known, skip_known
from pairloom.operators.pairing import pair_listed
from pairloom.operators.stats import repo_stats
from pairloom.operators.validate import has_repository, require_rows, valid_files
from pairloom.plans.mine import mine_by_test_file
from pairloom.schemas import CODE_FILES, DATA_PAIRS, FILE_LEDGER, FUNCTION_PAIRS, PARSED, REPO_LEDGER, REPO_STATS
from pairloom.session import stored
from pairloom.sources.state import read_table

PARSED_FILES = T.StructType([f for f in CODE_FILES if f.name != "content"] + list(PARSED))
BATCH = T.StructField("batch_id", T.LongType())
OPEN = T.StructType([*FILE_LEDGER, T.StructField("arrived", T.LongType())])
NO_REPOSITORY = "no repository"


def start_parsing(spark: SparkSession, landing: str, out: str, batch: int) -> StreamingQuery:
    """Parse every file that has landed and was not parsed before, for ``batch`` to pair, then stop.

    A file without a repository is not parsed; it has one row of status ``no repository``.
    """
    files = spark.readStream.schema(CODE_FILES).parquet(landing)
    usable = files.withColumn("content", F.when(has_repository(), F.col("content")))
    status = F.when(has_repository(), F.col("parse_status")).otherwise(NO_REPOSITORY)
    return (
        parse_files(usable, keep_empty=True)
        .withColumns({"parse_status": status, "batch_id": F.lit(batch).cast("long")})
        .writeStream.format("parquet")
        .partitionBy("batch_id")
        .option("checkpointLocation", f"{out}/_parsing")
        .trigger(availableNow=True)
        .start(f"{out}/parsed")
    )


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, BATCH])


def read_committed(spark: SparkSession, out: str, table: str, schema: T.StructType, last: int | None = None) -> DataFrame:
    """Rows of finished batches: those up to ``last``, by default the last one in the ledger."""
    if last is None:
        last = last_batch(spark, out)
    rows = read_table(spark, f"{out}/{table}", _with_batch(schema))
    return rows.where(F.col("batch_id") <= last).drop("batch_id")


def last_batch(spark: SparkSession, out: str) -> int:
    """Number of the last finished batch, -1 before the first. Reads partition values of the ledger only."""
    ledger = read_table(spark, f"{out}/ledger", _with_batch(REPO_LEDGER))
    return ledger.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]


def _write_batch(rows: DataFrame, out: str, table: str, batch: int) -> DataFrame:
    path = f"{out}/{table}/batch_id={batch}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _parsed(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    """Parsed rows that arrived for some batches. Only their folders are read."""
    return read_table(spark, f"{out}/parsed", _with_batch(PARSED_FILES)).where(F.col("batch_id").isin(batches))


def _write_rejected(spark: SparkSession, out: str, batch: int) -> None:
    """Names of the files of a batch that have no repository."""
    rejected = _parsed(spark, out, [batch]).where(F.col("parse_status") == NO_REPOSITORY)
    _write_batch(rejected.select("repository_full_name", "file_path", "file_pos"), out, "rejected", batch)


def _waiting_files(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """Files that arrived for a batch, and those the batch before left open: names, and the batch that has their rows."""
    new = valid_files(_parsed(spark, out, [batch])).select(*FILE_LEDGER.fieldNames(), F.col("batch_id").alias("arrived"))
    left = read_table(spark, f"{out}/open", _with_batch(OPEN)).where(F.col("batch_id") == batch - 1).drop("batch_id")
    return new.distinct().unionByName(left)


def complete_repositories(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """Repositories of which all files are there; ``expected`` has (repository_full_name, num_files)."""
    arrived = parsed.groupBy("repository_full_name").agg(F.count_distinct("file_path").alias("_arrived"))
    known = expected.select("repository_full_name", "num_files")
    return arrived.join(known, "repository_full_name").where("_arrived >= num_files").select("repository_full_name")


def pair_new_repositories(spark: SparkSession, out: str, batch: int, expected: DataFrame | None = None) -> int | None:
    """Pair the parsed files of repositories that are not done; returns the batch number, None if there is nothing to pair.

    With ``expected``, the number of files of each repository, a repository
    stays open until all of them have arrived, and its files are listed
    in ``open`` again by each batch, without their code. Without it what has arrived counts as complete. As a done repository
    is skipped for good, files that arrive for it later are parsed and not
    paired.
    """
    ledger = read_committed(spark, out, "ledger", REPO_LEDGER, batch - 1)
    repository = REPO_LEDGER.fieldNames()
    waiting = stored(skip_known(_waiting_files(spark, out, batch), ledger, repository), "waiting")
    if expected is None:
        complete = waiting.select(*repository).distinct()
    else:
        complete = complete_repositories(waiting, expected)
    complete = stored(complete, "complete")
    if complete.isEmpty():
        return None
    # One number for each run that brought files of these repositories.
    runs = [r["arrived"] for r in keep_known(waiting, complete, repository).select("arrived").distinct().collect()]
    if expected is not None:
        _write_batch(skip_known(waiting, complete, repository), out, "open", batch)
    functions = named_functions(keep_known(_parsed(spark, out, runs).drop("batch_id"), complete, repository))
    _commit(complete, functions, out, batch)
    return batch


def _commit(repositories: DataFrame, functions: DataFrame, out: str, batch: int) -> None:
    """Pairs, then statistics from the written pairs, then the ledger."""
    pairs = _write_batch(pair_listed(functions), out, "pairs", batch)
    stats = _write_batch(repo_stats(repositories, pairs), out, "stats", batch)
    _write_batch(stats.select(F.col("repository").alias("repository_full_name")), out, "ledger", batch)


def mine_available(spark: SparkSession, landing: str, out: str, expected: DataFrame | None = None) -> int | None:
    """One resumable run over whatever has landed; see ``pair_new_repositories`` for ``expected``."""
    batch = last_batch(spark, out) + 1
    start_parsing(spark, landing, out, batch).awaitTermination()
    _write_rejected(spark, out, batch)
    return pair_new_repositories(spark, out, batch, expected)


def mine_file_list(spark: SparkSession, file_list: DataFrame, contents: DataFrame, out: str) -> int | None:
    """Mode B over a file list, committed: the listed files are parsed once, then pairs, statistics and ledger are written.

    Returns the batch number, None if every repository of the list is done. An
    empty list is an error. A run that died is repeated under its number.
    """
    require_rows(file_list)
    batch = last_batch(spark, out) + 1
    ledger = read_committed(spark, out, "ledger", REPO_LEDGER, batch - 1)
    listed = skip_known(valid_files(file_list), ledger, REPO_LEDGER.fieldNames())
    todo = stored(listed.groupBy(*FILE_LEDGER.fieldNames()).agg(F.max("file_pos").alias("file_pos")), "listed")
    if todo.isEmpty():
        return None
    functions = stored(extract_functions(attach_content(todo, contents), last_only=True), "functions")
    _commit(todo.select("repository_full_name").distinct(), functions, out, batch)
    return batch


def mine_new_test_files(spark: SparkSession, file_list: DataFrame, contents: DataFrame, out: str) -> int:
    """Mode A over the listed test files that are not in the ledger; returns the batch number.

    Test files without tests are not entered, so a later run looks at them again.
    """
    batch = last_batch(spark, out) + 1
    ledger = read_committed(spark, out, "ledger", FILE_LEDGER, batch - 1)
    mined = mine_by_test_file(file_list, contents, ledger)
    _write_batch(mined.pairs, out, "pairs", batch)
    _write_batch(mined.done, out, "ledger", batch)
    return batch


def committed_data_pairs(spark: SparkSession, out: str) -> DataFrame:
    return read_committed(spark, out, "pairs", DATA_PAIRS)


def committed_pairs(spark: SparkSession, out: str) -> DataFrame:
    return read_committed(spark, out, "pairs", FUNCTION_PAIRS)


def committed_stats(spark: SparkSession, out: str) -> DataFrame:
    return read_committed(spark, out, "stats", REPO_STATS)


def committed_repos(spark: SparkSession, out: str) -> DataFrame:
    return read_committed(spark, out, "ledger", REPO_LEDGER)
