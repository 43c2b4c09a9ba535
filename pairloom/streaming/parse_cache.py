"""Parsing by content: every distinct text is parsed once, over all files and runs.

Forks and vendored copies make most files of a code corpus equal to another
one. A content is known by its SHA-256. A run finds the contents that no run
before has parsed, from their keys alone; parses one file of each where it
stands; and adds the functions to the cache as one numbered batch. Functions
of any table of files are then a join of its keys with the cache.

Folders of a cache: ``functions/batch_id=N`` with the rows of the parser under
their content key, and ``index/batch_id=N`` with the keys, written last. A
batch without an index was not finished: it is not read, and its number is
used again. One run at a time may add to a cache.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairloom.operators.extract import named_functions, parse_files
from pairloom.operators.joins import BROADCAST_ROWS, fits_broadcast, heavy_keys, keep_known, skewed_lookup, skip_known
from pairloom.operators.bloom import Sieve
from pairloom.operators.validate import with_content
from pairloom.schemas import PARSED
from pairloom.session import stored
from pairloom.sources.state import read_table

KEY = "content_key"
FILE = ["repository_full_name", "file_path"]
_KEY = T.StructField(KEY, T.BinaryType())
_BATCH = T.StructField("batch_id", T.LongType())
INDEX = T.StructType([_KEY, _BATCH])
FUNCTIONS = T.StructType([_KEY, *PARSED.fields, _BATCH])


def content_key(content: str | Column = "content") -> Column:
    return F.unhex(F.sha2(F.col(content) if isinstance(content, str) else content, 256))


class ParseCache:
    """The cache in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def index(self) -> DataFrame:
        """(content_key, batch_id) of every content of a finished batch."""
        return read_table(self.spark, f"{self.path}/index", INDEX)

    def last_batch(self) -> int:
        """-1 before the first. Reads partition values only."""
        return self.index().agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]

    def add(self, files: DataFrame, rows: int = BROADCAST_ROWS) -> int | None:
        """Parse the contents that are not in the cache; the number of the batch, None if there are none.

        Contents of all files are hashed where they are read. Only the text of
        one file of each new content reaches the parser.
        """
        batch = self.last_batch() + 1
        new = self._new_contents(files, rows)
        if new.isEmpty():
            return None
        parsed = parse_files(_one_of_each(files, new, rows))
        parsed.write.mode("overwrite").parquet(f"{self.path}/functions/batch_id={batch}")
        new.select(KEY).write.mode("overwrite").parquet(f"{self.path}/index/batch_id={batch}")
        return batch

    def _new_contents(self, files: DataFrame, rows: int) -> DataFrame:
        """(content_key, place, copies): a place each new content stands at, and the rows that stand there."""
        places = with_content(files).groupBy(content_key().alias(KEY), _place().alias("place")).agg(F.count("*").alias("n"))
        first = places.groupBy(KEY).agg(F.min("place").alias("place"), F.min_by("n", "place").alias("copies"))
        return stored(skip_known(first, self.index(), [KEY], spread=KEY, rows=rows), "new-contents")

    def parsed(self, files: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
        """What ``parse_files`` gives for the files, from the cache. Contents that were not added have no rows.

        Functions meet their files by content key: a content that a large part
        of the files has is copied to salts, not collected in one task.
        """
        others = [c for c in files.columns if c != "content"]
        keyed = stored(with_content(files).select(*others, content_key().alias(KEY)), "content-keys")
        wanted = stored(keyed.select(KEY).distinct(), "wanted")
        fits, count = fits_broadcast(wanted, rows)
        # Only batches that have one of the contents are read, and only functions that may be wanted are shuffled.
        batches = [r["batch_id"] for r in keep_known(self.index(), wanted, [KEY], spread=KEY, rows=rows).select("batch_id").distinct().collect()]
        cached = read_table(self.spark, f"{self.path}/functions", FUNCTIONS).where(F.col("batch_id").isin(batches)).drop("batch_id")
        if fits:
            cached = cached.join(F.broadcast(wanted), KEY, "left_semi")
        else:
            cached = Sieve(wanted, [KEY], count).may_match(cached)
        return skewed_lookup(keyed, cached, [KEY], heavy_keys(keyed, [KEY])).select(*others, *PARSED.fieldNames())

    def functions(self, files: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
        """What ``extract_functions`` gives for the files."""
        return named_functions(self.parsed(files, rows))


def _place() -> Column:
    return F.xxhash64(*FILE)


def _one_of_each(files: DataFrame, new: DataFrame, rows: int) -> DataFrame:
    """(content_key, content) of one row for each new content, without moving any content that stands at one row only."""
    places = stored(new.select("place").distinct(), "places")
    at_place = keep_known(with_content(files).withColumn("place", _place()), places, ["place"], spread="place", rows=rows)
    # Two files may share a hash of the place, or a file two contents: the content decides.
    keyed = at_place.select(content_key().alias(KEY), "place", "content")
    alone = keep_known(keyed, new.where("copies = 1"), [KEY, "place"], spread=KEY, rows=rows).select(KEY, "content")
    repeated = new.where("copies > 1")
    if repeated.isEmpty():
        return alone
    # The same file several times over: only such rows are brought together.
    again = keep_known(keyed, repeated, [KEY, "place"], spread=KEY, rows=rows)
    return alone.unionByName(again.groupBy(KEY).agg(F.any_value("content").alias("content")))
