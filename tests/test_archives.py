import io
import tarfile
import zipfile

import pytest

from pairloom.functions.names import is_source_file
from pairloom.sources import archives
from pairloom.sources.archives import archive_report, read_archives, unpack

FILES = {"r-1/a.py": b"x = 1", "r-1/pkg/é.py": "y = 'é'".encode(), "r-1/tests/test_a.py": b"t", "r-1/bad.py": b"z\xff = 2", "r-1/README": b"r", "r-1/empty.py": b""}


def zipped(files=FILES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.mkdir("r-1/pkg")
        for name, raw in files.items():
            archive.writestr(name, raw)
    return out.getvalue()


def tarred(files=FILES, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        folder = tarfile.TarInfo("r-1/pkg")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
        for name, raw in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            archive.addfile(info, io.BytesIO(raw))
        link = tarfile.TarInfo("r-1/link.py")
        link.type, link.linkname = tarfile.SYMTYPE, "a.py"
        archive.addfile(link)
    return out.getvalue()


def of(spark, *rows):
    return spark.createDataFrame([(name, bytearray(raw) if raw is not None else None) for name, raw in rows], "repository_full_name string, content binary")


SOURCES = {("a.py", "x = 1"), ("pkg/é.py", "y = 'é'"), ("bad.py", "z = 2"), ("empty.py", "")}


def test_folder_of_archives(spark, tmp_path):
    for name, raw in {"own/r.zip": zipped(), "own/t.tar.gz": tarred(), "two/u.tar": tarred(mode="w"), "two/notes.txt": b"n"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(raw)
    got = unpack(read_archives(spark, str(tmp_path)), is_source_file).collect()
    for repo in ("own/r", "own/t", "two/u"):
        assert {(r.file_path, r.content) for r in got if r.repository_full_name == repo} == SOURCES
    assert len(got) == 12


@pytest.mark.parametrize("make", [zipped, tarred])
def test_all_members_in_order(spark, make):
    got = unpack(of(spark, ("o/r", make()))).orderBy("member_pos").collect()
    assert [r.file_path for r in got] == [n.removeprefix("r-1/") for n in FILES]
    whole = unpack(of(spark, ("o/r", make())), strip=0).orderBy("member_pos").collect()
    assert [r.file_path for r in whole] == list(FILES)


def test_only_wanted_members_are_inflated():
    """A damaged member that nobody asks for does no harm, and one that is asked for costs itself alone."""
    raw = bytearray(zipped({"r-1/a.py": b"a" * 500, "r-1/b.py": bytes(range(256)) * 8, "r-1/c.py": b"c"}))
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        at = archive.getinfo("r-1/b.py").header_offset
    raw[at + 60 : at + 90] = b"\xff" * 30
    numbers = {name: no for no, name, _ in archives._members(bytes(raw))}
    rows = lambda *names: [n for b in archives._files("o/r", bytes(raw), {numbers[f"r-1/{n}"]: n for n in names}) for n in b.column(1).to_pylist()]
    assert rows("a.py", "c.py") == ["a.py", "c.py"]
    assert rows("a.py", "b.py", "c.py") == ["a.py", "c.py"]


def test_odd_archives(spark):
    good = zipped()
    df = of(spark, ("o/null", None), ("o/none", b""), ("o/text", b"no archive"), ("o/cut", tarred(mode="w")[:2600]), ("o/good", good), (None, good), ("o/empty", zipped({})))
    found = {r.repository_full_name: (r.status, r.num_files) for r in archive_report(df).collect()}
    assert found["o/null"] == ("empty", 0) and found["o/none"] == found["o/text"] == ("unreadable", 0)
    assert found["o/good"] == found[None] == ("ok", 6) and found["o/empty"] == ("ok", 0)
    assert found["o/cut"][1] < 6
    rows = unpack(df, is_source_file).collect()
    assert {r.repository_full_name for r in rows} <= {"o/good", None, "o/cut"}
    assert sum(r.repository_full_name is None for r in rows) == 4
    assert unpack(df.limit(0)).count() == 0


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 100)
    raw = zipped({f"r-1/{i}.py": b"x" * 40 for i in range(9)} | {"r-1/long.py": b"y" * 900})
    asked = {no: name for no, name, _ in archives._members(raw)}
    sizes = [[len(v.as_py()) for v in b.column(3)] for b in archives._files("o/r", raw, asked)]
    assert sum(len(s) for s in sizes) == 10 and all(sum(s) <= 100 or len(s) == 1 for s in sizes)
