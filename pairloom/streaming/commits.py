"""Appends that count once, and tables that stay at a bounded number of folders.

Folders: ``rows/<level>-<id>`` with the rows of one append, or of several that
were put together, and ``log/version=N`` with one row for each append there
has been: its key and the folder its rows are in now. Readers take the folders
named in the last version, so an append or a compaction that died is not seen,
and is repeated. Nothing is rewritten in place.

When a level has ``fan`` folders they become one of the next level: a row is
rewritten once for each level, and n appends leave at most ``fan`` folders for
each of log(n) levels. One writer at a time.
"""

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairloom.sources.state import read_table

ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("folder", T.StringType())])
VERSION = T.StructField("version", T.LongType())
FILE_BYTES = 128 << 20
KEEP_HOURS = 24.0


class CommittedTable:
    """A table of one schema that grows by keyed appends."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fan: int = 16) -> None:
        if fan < 2:
            raise ValueError("at least two folders are put together")
        self.spark, self.path, self.schema, self.fan = spark, path, schema, fan

    def _last(self) -> int:
        """Number of the last version, -1 before the first."""
        log = read_table(self.spark, f"{self.path}/log", T.StructType([*ENTRY.fields, VERSION]))
        return log.agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def _entries(self, version: int) -> DataFrame:
        return read_table(self.spark, f"{self.path}/log/version={version}", ENTRY)

    def _folders(self, entries: DataFrame) -> list[str]:
        """A bounded number of names, see above."""
        return sorted(r["folder"] for r in entries.select("folder").distinct().collect())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/rows/{name}" for name in folders))

    def keys(self) -> DataFrame:
        """Keys of all appends."""
        return self._entries(self._last()).select("key")

    def rows(self) -> DataFrame:
        return self._read(self._folders(self._entries(self._last())))

    def append(self, rows: DataFrame, key: str) -> bool:
        """Add rows under a key; False, and nothing changes, if an append with this key is in the table."""
        version = self._last()
        entries = self._entries(version)
        if not entries.where(F.col("key") == key).isEmpty():
            return False
        folder = f"0-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/rows/{folder}")
        self._commit(entries.unionByName(self.spark.createDataFrame([(key, folder)], ENTRY)), version + 1)
        self.compact()
        return True

    def _commit(self, entries: DataFrame, version: int) -> None:
        # One file, so that the version is there as a whole or not at all.
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")

    def compact(self) -> None:
        """Put the folders of each full level together, from the lowest level on."""
        version = self._last()
        folders = self._folders(self._entries(version))
        level = 0
        while any(_level(name) >= level for name in folders):
            full = [name for name in folders if _level(name) == level]
            if len(full) >= self.fan:
                merged = f"{level + 1}-{uuid.uuid4().hex}"
                files = max(1, -(-self._bytes(full) // FILE_BYTES))
                self._read(full).coalesce(files).write.parquet(f"{self.path}/rows/{merged}")
                moved = F.when(F.col("folder").isin(full), merged).otherwise(F.col("folder")).alias("folder")
                self._commit(self._entries(version).select("key", moved), version + 1)
                version += 1
                folders = [name for name in folders if name not in full] + [merged]
            level += 1

    def unused(self, keep_hours: float = KEEP_HOURS) -> list[str]:
        """Folders that the last version does not name, and earlier versions, not touched for some hours.

        The hours are for readers that began on an earlier version, and for an append that is under way.
        """
        last = self._last()
        named = {*self._folders(self._entries(last)), f"version={last}"}
        before = (time.time() - keep_hours * 3600) * 1000
        found = [status for part in ("rows", "log") for status in self._statuses(part)]
        return sorted(
            status.getPath().toString()
            for status in found
            if status.getPath().getName() not in named and status.getModificationTime() <= before
        )

    def remove_unused(self, keep_hours: float = KEEP_HOURS) -> list[str]:
        """Delete what ``unused`` lists; returns it. Needs a table with at least one version."""
        gone = self.unused(keep_hours) if self._last() >= 0 else []
        for folder in gone:
            path = self._hadoop_path(folder)
            self._store(path).delete(path, True)
        return gone

    def _hadoop_path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _store(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _statuses(self, part: str) -> list:
        path = self._hadoop_path(f"{self.path}/{part}")
        store = self._store(path)
        return [status for status in store.listStatus(path) if status.isDirectory()] if store.exists(path) else []

    def _bytes(self, folders: list[str]) -> int:
        paths = [self._hadoop_path(f"{self.path}/rows/{name}") for name in folders]
        return sum(self._store(path).getContentSummary(path).getLength() for path in paths)


def _level(folder: str) -> int:
    return int(folder.split("-", 1)[0])
