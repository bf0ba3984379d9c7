"""Archives read by ranges, in partitions planned from their directories."""

import os
import random
import zipfile

import pytest

from folioflow.sources import archives, docx, files
from tests.test_word import PARTS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    r = random.Random(1)
    (at / "deep").mkdir()
    for name, n in (("a.idml", 9), ("deep/b.IDML", 4), ("c.zip", 2)):
        with zipfile.ZipFile(at / name, "w") as z:
            z.mkdir("empty")
            for i in range(n):
                packing = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
                z.writestr(f"dir/m{i}.bin", r.randbytes(3000) if i % 3 else b"", packing)
    return at


def test_members_are_those_of_the_archives(spark, folder):
    got = {(os.path.basename(r.path), r.member): bytes(r.content) for r in archives.members(spark, str(folder), ".idml").collect()}
    want = {}
    for name in ("a.idml", "deep/b.IDML"):
        with zipfile.ZipFile(folder / name) as z:
            want |= {(os.path.basename(name), i.filename): z.read(i) for i in z.infolist() if not i.is_dir()}
    assert got == want and len(got) == 13


def test_an_archive_is_dealt_to_many_partitions(spark, folder):
    df = archives.members(spark, str(folder / "a.idml"), partitionBytes=4000)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 9
    parts = archives.planned([str(folder / "a.idml")], 4000, False)
    assert [m.name for p in parts for m in p.members] == [f"dir/m{i}.bin" for i in range(9)] and all(sum(m.packed for m in p.members) <= 4000 for p in parts)


def test_only_a_members_own_range_is_read(folder):
    path = str(folder / "a.idml")
    member = archives.directory(path)[4]
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append((self.f.tell(), n))
            return self.f.read(n)

    with open(path, "rb") as f:
        assert len(archives.unpacked(Counted(f), member)) == 3000
    assert sum(n for _, n in read) == 30 + member.packed and min(at for at, _ in read) == member.offset


def test_broken_archives(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("good", "good")
        z.writestr("bad", "some text that is spoilt")
    data = bytearray((tmp_path / "y.zip").read_bytes())
    at = data.index(b"spoilt")
    data[at : at + 6] = b"SPOILT"
    (tmp_path / "y.zip").write_bytes(data)
    rows = {(os.path.basename(r.path), r.member): (r.content and bytes(r.content), r.error) for r in archives.members(spark, str(tmp_path), permissive=True).collect()}
    assert rows[("y.zip", "good")] == (b"good", None) and rows[("y.zip", "bad")] == (None, "wrong check sum") and rows[("x.zip", None)][1]
    with pytest.raises(Exception, match="not a zip file"):
        archives.members(spark, str(tmp_path / "x.zip")).count()
    with pytest.raises(Exception, match="wrong check sum"):
        archives.members(spark, str(tmp_path / "y.zip")).select("content").collect()
    with pytest.raises(Exception, match="missing"):
        archives.members(spark, str(tmp_path / "missing")).count()


def test_readers_take_its_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        for name, body in PARTS.items():
            z.writestr(name, body)
    rows = archives.members(spark, str(tmp_path), ".docx").select("path", "member", "content")
    whole = files.members(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [r.html for r in docx.body_pages(rows).orderBy("page_no").collect()] == [r.html for r in docx.body_pages(whole).orderBy("page_no").collect()]
