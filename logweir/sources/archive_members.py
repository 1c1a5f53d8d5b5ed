"""Members of zipped archives as a data source that reads ranges of files.

``spark.read.format("archive_members").load(folder)`` plans from the central directories
at the ends of the archives: a partition is one member, or several small ones. A task
seeks to its members and inflates them as streams, so neither an archive nor a member is
ever held whole, archives may be of any size, and the members of one archive are read
side by side. A deflated member can only be read from its start, so it is not split.

Options: ``glob`` (names of archives, ``*.zip``), ``members`` (a glob of member names; without
it the one text member named like its archive), ``sep`` (``|``), ``partitionBytes`` (small
members share a partition up to this many compressed bytes).

An archive, member or record that cannot be read gives one row with ``error`` and no
fields; what was read of a member before its fault stays. An empty folder gives no rows.
"""

from __future__ import annotations

import csv
import io
import sys
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import RECORD_SCHEMA

FORMAT = "archive_members"
PARTITION_BYTES = 32 << 20
CHUNK = 1 << 20
ROWS = 10_000
LISTERS = 16
#: The bytes of a central directory without members.
LEAST_ARCHIVE = 22
READ_ERRORS = (zipfile.BadZipFile, KeyError, NotImplementedError, OSError, EOFError, zlib.error)

_ARROW = pa.schema([
    ("path", pa.string()), ("member", pa.string()), ("record_no", pa.int64()), ("fields", pa.list_(pa.string())), ("error", pa.string()),
])


def read_members(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Records of the archives below a folder: path, member, record_no, fields, error."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(folder)


@dataclass
class Member:
    """Where a member lies; ``error`` where the directory already says it cannot be read."""

    path: str
    name: str
    offset: int = 0
    packed: int = 0
    method: int = zipfile.ZIP_STORED
    crc: int = 0
    error: str | None = None


@dataclass
class Members(InputPartition):
    members: list[Member]


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> "MemberReader":
        return MemberReader(dict(self.options))


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.glob = options.get("glob", "*.zip")
        self.members = options.get("members")
        self.sep = options.get("sep", "|")
        self.limit = int(options.get("partitionBytes", options.get("partitionbytes", PARTITION_BYTES)))

    def partitions(self) -> list[Members]:
        files, root = opened(self.root)
        found = files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and fnmatchcase(f.base_name, self.glob))
        with ThreadPoolExecutor(LISTERS) as pool:
            listed = pool.map(lambda path: directory(files, path, self.members), paths)
            return shared([m for members in listed for m in members], self.limit) or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        files, _ = opened(self.root)
        for member in partition.members:
            rows: list[tuple] = []
            for number, fields, error in records(files, member, self.sep):
                rows.append((member.path, member.name, number, fields, error))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def directory(files: arrow_fs.FileSystem, path: str, pattern: str | None) -> list[Member]:
    """The members wanted of one archive, from its central directory."""
    own = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".txt"
    try:
        with files.open_input_file(path) as raw:
            if raw.size() < LEAST_ARCHIVE:
                raise zipfile.BadZipFile("too short for an archive")
            archive = zipfile.ZipFile(raw)
            if pattern is None:
                infos = [archive.getinfo(own)]
            else:
                infos = [i for i in archive.infolist() if not i.is_dir() and fnmatchcase(i.filename, pattern)]
            return [
                Member(path, i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC, "encrypted member" if i.flag_bits & 1 else None)
                for i in infos
            ]
    except READ_ERRORS as e:
        return [Member(path, own, error=f"{type(e).__name__}: {e}")]


def shared(members: list[Member], limit: int) -> list[Members]:
    """Members dealt to partitions in order; one above the limit has its own."""
    parts: list[Members] = []
    room = 0
    for member in members:
        if not parts or member.packed > room:
            parts.append(Members([]))
            room = limit
        parts[-1].members.append(member)
        room -= member.packed
    return parts


def records(files: arrow_fs.FileSystem, member: Member, sep: str) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """Numbered records of a member, without its header line."""
    number = 0
    if member.error:
        yield number, None, member.error
        return
    try:
        with files.open_input_file(member.path) as raw:
            text = io.TextIOWrapper(io.BufferedReader(_Inflated(raw, member), CHUNK), "utf-8", errors="replace", newline="")
            reader = csv.reader(text, delimiter=sep)
            next(reader, None)
            while True:
                number += 1
                try:
                    yield number, next(reader), None
                except StopIteration:
                    return
                except csv.Error as e:
                    yield number, None, str(e)
    except READ_ERRORS as e:
        yield number, None, f"{type(e).__name__}: {e}"


class _Inflated(io.RawIOBase):
    """The bytes of a member, read from its range of the file."""

    def __init__(self, raw: pa.NativeFile, member: Member) -> None:
        raw.seek(member.offset)
        head = raw.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no member where the directory says")
        # the lengths of name and extra field, which may differ from the directory's
        raw.seek(member.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise NotImplementedError(f"compression method {member.method}")
        self.raw, self.left, self.expected = raw, member.packed, member.crc
        self.inflater = zlib.decompressobj(-zlib.MAX_WBITS) if member.method == zipfile.ZIP_DEFLATED else None
        self.pending, self.crc = b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        out = b""
        while not out:
            if self.inflater is None:
                out = self._packed(len(into))
            else:
                out = self.inflater.decompress(self.pending or self._packed(CHUNK), len(into))
                self.pending = self.inflater.unconsumed_tail
            if not out and not self.pending and not self.left:
                if self.crc != self.expected:
                    raise zipfile.BadZipFile("checksum of a member differs")
                return 0
        self.crc = zlib.crc32(out, self.crc)
        into[: len(out)] = out
        return len(out)

    def _packed(self, size: int) -> bytes:
        data = self.raw.read(min(size, self.left))
        if self.left and not data:
            raise EOFError("the archive ends within a member")
        self.left -= len(data)
        return data


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
