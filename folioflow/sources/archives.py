"""Archives as a data source of Spark: partitions are planned from the archives' directories, and members are read by ranges.

``files.members`` takes whole archives in a binary column, so one can't be larger than a row and one task unpacks it. Here
the driver reads the directory at an archive's end (a ranged read), and deals its members to partitions of some ``partitionBytes`` packed
bytes; a task reads its members alone, each from its own place, and holds one at a time. A large archive is thus
unpacked by many tasks, and no archive is ever held whole.

    archives.register(spark)
    spark.read.format("archive").option("pattern", ".idml").load(folder)

Paths are local ones or URIs that ``pyarrow.fs`` opens. A broken archive, and a member that is encrypted, packed in an unknown way or fails its check sum, is an
error, or, with ``permissive``, a row with its ``error``.
"""

from __future__ import annotations

import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, member string, size long, content binary, error string"
PARTITION_BYTES = 64 << 20
_CHUNK = 1 << 20


def _opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, pattern: str) -> list[str]:
    """The files at or below ``path`` whose names end with ``pattern``, in order."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(pattern.lower()))


@dataclass(frozen=True)
class Member:
    """Where a member lies in its archive."""

    path: str
    name: str
    offset: int
    packed: int
    size: int
    method: int
    flags: int
    crc: int


@dataclass
class Part(InputPartition):
    members: list[Member]
    broken: list[tuple[str, str]]


def directory(path: str) -> list[Member]:
    """The members of an archive, from its directory."""
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        if f.size() < 22:  # the least end of a directory
            raise zipfile.BadZipFile("File is not a zip file")
        z = zipfile.ZipFile(f)
        return [Member(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC) for i in z.infolist() if not i.is_dir()]


def planned(paths: list[str], partition_bytes: int, permissive: bool) -> list[Part]:
    """Members dealt to partitions in order of place, each of some ``partition_bytes`` packed bytes."""
    parts, held, size, broken = [], [], 0, []
    for path in paths:
        try:
            found = directory(path)
            if not found:
                raise zipfile.BadZipFile("no members")
        except zipfile.BadZipFile as e:
            if not permissive:
                raise ValueError(f"{path}: {e}") from e
            broken.append((path, str(e)))
            continue
        for m in sorted(found, key=lambda m: m.offset):
            if held and size + m.packed > partition_bytes:
                parts.append(Part(held, []))
                held, size = [], 0
            held.append(m)
            size += m.packed
    if held or broken or not parts:
        parts.append(Part(held, broken))
    for i, p in enumerate(parts):
        p.value = i
    return parts


def unpacked(f, m: Member) -> bytes:
    """A member's content, read from its own place in the open file."""
    if m.flags & 1:
        raise zipfile.BadZipFile("encrypted")
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"unknown packing {m.method}")
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member at its place")
    f.seek(m.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    inflate, out, left = zlib.decompressobj(-15), [], m.packed
    while left:
        data = f.read(min(left, _CHUNK))
        if not data:
            raise zipfile.BadZipFile("cut off")
        left -= len(data)
        out.append(data if m.method == zipfile.ZIP_STORED else inflate.decompress(data))
    if m.method == zipfile.ZIP_DEFLATED:
        out.append(inflate.flush())
    content = b"".join(out)
    if len(content) != m.size or zlib.crc32(content) != m.crc:
        raise zipfile.BadZipFile("wrong check sum")
    return content


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.permissive = options.get("permissive", "false").lower() == "true"

    def partitions(self):
        return planned(listed(self.path, self.pattern), self.partition_bytes, self.permissive)

    def read(self, part: Part):
        for path, error in part.broken:
            yield (path, None, None, None, error)
        at, f = None, None
        try:
            for m in part.members:
                if m.path != at:
                    if f is not None:
                        f.close()
                    system, inside = _opened(m.path)
                    at, f = m.path, system.open_input_file(inside)
                try:
                    yield (m.path, m.name, m.size, unpacked(f, m), None)
                except (zipfile.BadZipFile, zlib.error) as e:
                    if not self.permissive:
                        raise ValueError(f"{m.path}, {m.name}: {e}") from e
                    yield (m.path, m.name, m.size, None, str(e))
        finally:
            if f is not None:
                f.close()


class ArchiveSource(DataSource):
    """``archive``: path, member, size, content and error of each member of the archives at a path; S3, S4, S13."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def members(spark: SparkSession, path: str, pattern: str = "", **options) -> DataFrame:
    """path, member, content of the members of all archives at ``path`` whose names end with ``pattern``."""
    register(spark)
    reader = spark.read.format("archive").option("pattern", pattern)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
