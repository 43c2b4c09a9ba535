"""Repository archives that have landed in storage, as zip or tar files.

Archives are bytes that Spark has read, from any store it reaches. Names are
listed first; which members are wanted is a Catalyst expression over their
paths; only wanted members are inflated (a compressed tar has to be read
through, its other members are skipped). One archive is one row, so it has
to fit a binary value, that is under 2 GB; members leave as rows of their own.
"""

import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from pairloom.functions.text import utf8_ignoring_errors

# Bytes of members that leave in one batch; a longer member is a batch alone.
BATCH_BYTES = 4 << 20

MEMBER = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("name", T.StringType())])
LISTED = T.StructType([T.StructField("status", T.StringType()), T.StructField("members", T.ArrayType(MEMBER))])

_LISTED = pa.struct([("status", pa.string()), ("members", pa.list_(pa.struct([("no", pa.int32()), ("name", pa.string())])))])
_UNREADABLE = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)


def _members(raw: bytes) -> Iterator[tuple[int, str, Callable[[], bytes]]]:
    """Number, name and reader of each regular file, in the order of the archive."""
    if raw[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            for no, info in enumerate(archive.infolist()):
                if not info.is_dir():
                    yield no, info.filename, lambda info=info: archive.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as archive:
            for no, info in enumerate(archive):
                if info.isfile():
                    yield no, info.name, lambda info=info: archive.extractfile(info).read()


def _listing(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    found = []
    try:
        for no, name, _ in _members(raw):
            found.append({"no": no, "name": name.encode("utf-8", "replace").decode()})
    except _UNREADABLE:
        return {"status": "cut off" if found else "unreadable", "members": found}
    return {"status": "ok", "members": found}


@arrow_udf(LISTED)
def list_members(archives: pa.Array) -> pa.Array:
    return pa.array([_listing(a.as_py()) for a in archives], _LISTED)


def _listed(archives: DataFrame) -> DataFrame:
    return archives.select("repository_full_name", "content", list_members("content").alias("_listed"))


def unpack(archives: DataFrame, wanted: Callable[[Column], Column] | None = None, strip: int = 1) -> DataFrame:
    """Files of a table of archives (``repository_full_name``, ``content`` binary).

    Columns: repository_full_name, file_path, member_pos, content. ``wanted`` makes
    a condition of the path, such as ``names.is_source_file``; other members are
    not inflated. ``strip`` leading folders are taken off the names, as hosted
    archives put everything under one; a file outside such a folder is left out. Member bytes that are not UTF-8 are
    dropped. Null and unreadable archives have no rows; a damaged member is left
    out, and so is what follows the damage in a tar (``archive_report`` names the archives that can not be listed to their end).
    """
    path = lambda m: F.regexp_replace(m["name"], rf"^([^/]*(/|$)){{{strip}}}", "")
    keep = lambda m: (path(m) != "") & (F.lit(True) if wanted is None else wanted(path(m)))
    members = F.transform(F.filter("_listed.members", keep), lambda m: F.struct(m["no"].alias("no"), path(m).alias("path")))
    chosen = _listed(archives).select("repository_full_name", "content", members.alias("_wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = {m["no"]: m["path"] for m in batch.column(2)[row].as_py() or ()}
                if asked:
                    yield from _files(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), asked)

    files = chosen.mapInArrow(run, "repository_full_name string, file_path string, member_pos int, content binary")
    text = utf8_ignoring_errors(F.col("content").cast("string"))
    return files.select("repository_full_name", "file_path", "member_pos", text.alias("content"))


def _files(repository: str | None, raw: bytes, asked: dict[int, str]) -> Iterator[pa.RecordBatch]:
    names = ["repository_full_name", "file_path", "member_pos", "content"]
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        places, contents = zip(*held)
        columns = [
            pa.array([repository] * len(held), pa.string()),
            pa.array([asked[no] for no in places], pa.string()),
            pa.array(places, pa.int32()),
            pa.array(contents, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    try:
        for no, _, read in _members(raw):
            if no not in asked:
                continue
            try:
                content = read()
            except _UNREADABLE:
                continue
            if held and size + len(content) > BATCH_BYTES:
                yield rows()
                held, size = [], 0
            held.append((no, content))
            size += len(content)
    except _UNREADABLE:
        pass
    if held:
        yield rows()


def archive_report(archives: DataFrame) -> DataFrame:
    """Per archive whether it can be listed (``ok``, ``cut off``, ``unreadable``, ``empty`` for a null) and how many files it has."""
    return _listed(archives).select(
        "repository_full_name",
        F.coalesce("_listed.status", F.lit("empty")).alias("status"),
        F.coalesce(F.size("_listed.members"), F.lit(0)).alias("num_files"),
    )


def read_archives(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A folder of archives, ``<root>/<owner>/<repo>.zip`` (or ``.tar``, ``.tar.gz``, ``.tgz``), as a table for ``unpack``."""
    where = r"([^/]+/[^/]+?)\.(zip|tar|tar\.gz|tgz)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_extract("path", where, 1).alias("repository_full_name"), "content").where("repository_full_name <> ''")
