"""Code tables derived from the given tables. The same SQL runs on Spark and on the checking engine."""

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A derived table. Its rows are much wider than the rows it is made from, so those are spread first."""
    return spark.sql(text, **{t: spread(table(spark, sf_dir, t)) for t in tables})


def json_files(items: DataFrame, opening: str = "[", closing: str = "]") -> DataFrame:
    """Lines (``value``) of one JSON array for each partition, from a column of elements; of an object, from one of members."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = opening
        for batch in batches:
            marks = [mark, *[","] * batch.num_rows][: batch.num_rows]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(m + t for m, t in zip(marks, batch.column(0).to_pylist()))], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array([closing if mark == "," else opening + closing])], ["value"])

    return items.mapInArrow(lines, "value string")


def archives(files: DataFrame, positions: int = 512) -> DataFrame:
    """Archives (``repository_full_name``, ``content``) of the files of a repository, one for each range of positions; zip and tar in turn."""

    def pack(key, group):
        out, members = io.BytesIO(), [(f"top/{r['file_path']}", r["content"].encode()) for r in group.to_pylist()]
        if key[1].as_py() % 2:
            with tarfile.open(fileobj=out, mode="w:gz") as archive:
                for name, raw in members:
                    info = tarfile.TarInfo(name)
                    info.size = len(raw)
                    archive.addfile(info, io.BytesIO(raw))
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, raw in members:
                    archive.writestr(name, raw)
        return pa.table({"repository_full_name": [key[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    part = F.floor(F.col("file_pos") / positions).alias("part")
    return files.groupBy("repository_full_name", part).applyInArrow(pack, "repository_full_name string, content binary")


# Small functions: repeated names, `latest` in paths, unparsable files, tests without a function.
CODE_FILES = """
SELECT 'org/r' || CAST(p_partkey % 25 AS STRING) AS repository_full_name,
       CASE p_partkey % 4 WHEN 0 THEN 'src/m' WHEN 1 THEN 'm' WHEN 2 THEN 'src/latest/m' ELSE 'pkg/sub/m' END
         || CAST(p_partkey AS STRING) || '.py' AS file_path,
       p_partkey * 2 AS file_pos,
       CASE WHEN p_partkey % 97 = 0 THEN 'def broken(:'
            ELSE 'def f_' || CAST(p_partkey % 500 AS STRING) || '(a, b):' || chr(10)
              || '    if a > ' || CAST(p_size AS STRING) || ':' || chr(10)
              || '        return a + b' || chr(10) || '    return b' END AS content
FROM {part}
UNION ALL
SELECT 'org/r' || CAST(p_partkey % 25 AS STRING), 'tests/test_m' || CAST(p_partkey AS STRING) || '.py',
       p_partkey * 2 + 1,
       'def test_f_' || CAST(p_partkey % 600 AS STRING) || '():' || chr(10)
         || '    assert f_' || CAST(p_partkey % 600 AS STRING) || '(1, 2)'
FROM {part} WHERE p_partkey % 3 = 0
"""

# Whole documents as comments inside functions. One repository has a third of
# all files, and its names repeat. Each source file has a method and, written
# after it but first in breadth-first order, a function.
DOC_PARTS = """
SELECT doc_id,
       CASE WHEN doc_id % 3 = 0 THEN 'docs/hot' ELSE 'docs/' || source END AS repo,
       'src/' || lang || '/m' || CAST(doc_id AS STRING) || '.py' AS src_path,
       'tests/' || lang || '/test_m' || CAST(doc_id AS STRING) || '.py' AS test_path,
       'f_' || CAST(doc_id % 40 AS STRING) AS method_name,
       'g_' || CAST(doc_id AS STRING) AS function_name,
       'def f_' || CAST(doc_id % 40 AS STRING) || '(self, x):' || chr(10)
         || '        # ' || replace(text, chr(10), chr(10) || '        # ') || chr(10)
         || '        return x' AS method_code,
       'def g_' || CAST(doc_id AS STRING) || '(x):' || chr(10) || '    return x' AS function_code,
       'def test_f_' || CAST(doc_id % 40 AS STRING) || '():' || chr(10)
         || '    # ' || replace(text, chr(10), chr(10) || '    # ') || chr(10)
         || '    assert True' AS test_code
FROM {documents}
"""

DOC_FILES = f"""
WITH p AS ({DOC_PARTS})
SELECT repo AS repository_full_name, src_path AS file_path, doc_id * 2 AS file_pos,
       'class C:' || chr(10) || '    ' || method_code || chr(10) || chr(10) || function_code || chr(10) AS content
FROM p
UNION ALL
SELECT repo, test_path, doc_id * 2 + 1, test_code || chr(10) FROM p WHERE doc_id % 2 = 0
"""

# What extraction finds in DOC_FILES.
DOC_FUNCTIONS = f"""
WITH p AS ({DOC_PARTS})
SELECT repo, src_path AS path, doc_id * 2 AS file_pos, 0 AS fn_pos, function_name AS name, function_code AS code FROM p
UNION ALL SELECT repo, src_path, doc_id * 2, 1, method_name, method_code FROM p
UNION ALL SELECT repo, test_path, doc_id * 2 + 1, 0, 'test_' || method_name, test_code FROM p WHERE doc_id % 2 = 0
"""

# Raw file-list items, a part of them unusable.
LIST_ITEMS = """
SELECT o_orderkey AS pos,
       CASE WHEN o_orderkey % 17 = 0 THEN '"plain text"'
            WHEN o_orderkey % 19 = 0 THEN '[1, 2]'
            WHEN o_orderkey % 23 = 0 THEN '{{"file_path":"a.py"}}'
            WHEN o_orderkey % 29 = 0 THEN '{{"repository_full_name":"","file_path":"a.py"}}'
            WHEN o_orderkey % 31 = 0 THEN '{{"repository_full_name":null,"file_path":"a.py"}}'
            WHEN o_orderkey % 37 = 0 THEN 'null'
            ELSE '{{"repository_full_name":"org/r' || CAST(o_custkey % 40 AS STRING)
              || '","file_path":"tests/test_' || CAST(o_orderkey AS STRING) || '.py"}}' END AS item_text
FROM {orders}
"""

# Raw pair items: test code missing without a label, null for a bad label;
# a part has no function name.
PAIR_ITEMS = """
SELECT d.doc_id,
       '{{' || CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE '"function_name":"f_' || CAST(d.doc_id AS STRING) || '",' END
         || CASE WHEN l.quality IS NULL THEN ''
                 WHEN l.quality = 0 THEN '"test_function_code":null,'
                 ELSE '"test_function_code":"def test_f():\\\\n    assert \\\\"é\\\\"",' END AS head,
       d.text
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
