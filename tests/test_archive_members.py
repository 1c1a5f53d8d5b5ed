from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from logweir.operators import devices as dv
from logweir.sources.archive_members import Member, read_members, shared
from logweir.sources.archives import read_archives, unpack_records

HEADER = "a|b\n"


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_members_are_read_side_by_side(spark, tmp_path):
    """As many tasks as members, and all rows, with no whole-file value in the plan."""
    members = {f"m{i}.txt": HEADER + "".join(f"{i}|{j}\n" for j in range(1000)) for i in range(6)}
    archive(tmp_path / "many.zip", members | {"notes.md": "not read"})
    df = read_members(spark, str(tmp_path), members="*.txt", partitionBytes=1)
    assert df.rdd.getNumPartitions() == 6
    assert "content" not in df.columns and "binaryFile" not in df._jdf.queryExecution().toString()
    got = {tuple(r) for r in df.select("member", "record_no", "fields").collect() for r in [(r[0], r[1], tuple(r[2]))]}
    assert got == {(f"m{i}.txt", j + 1, (str(i), str(j))) for i in range(6) for j in range(1000)}
    assert read_members(spark, str(tmp_path), members="*.txt").rdd.getNumPartitions() == 1


def test_same_records_as_whole_archives(spark, tmp_path, rows):
    """Random texts with quotes, breaks, stray bytes, stored and deflated, of several chunks."""
    rng = random.Random(5)
    parts = ["x", "é", '"q|""r"', '"two\nlines"', "", "|", "\n", "\r\n", "word " * 50]
    for i in range(6):
        body = "".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 20_000])))
        archive(tmp_path / f"f.{i}.zip", {f"f.{i}.txt": (HEADER + body).encode() + b"\xff"}, rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
    archive(tmp_path / "none.zip", {"none.txt": ""})
    name = F.regexp_extract("path", "[^/]*$", 0)
    columns = [name, "member", "record_no", "fields", "error"]
    whole = unpack_records(read_archives(spark, str(tmp_path)))
    ranges = read_members(spark, str(tmp_path))
    assert rows(ranges.select(*columns)) == rows(whole.select(*columns))
    assert ranges.count() > 1000


def test_faults_are_rows(spark, tmp_path):
    archive(tmp_path / "other.zip", {"x.txt": "a"})
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    archive(tmp_path / "bent.zip", {"bent.txt": HEADER + "1|2\n"}, zipfile.ZIP_STORED)
    data = (tmp_path / "bent.zip").read_bytes()
    (tmp_path / "bent.zip").write_bytes(data.replace(b"1|2", b"1|3", 1))
    archive(tmp_path / "lzma.zip", {"lzma.txt": HEADER}, zipfile.ZIP_LZMA)
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "good.zip", {"good.txt": HEADER + "1|2\n"})
    got = {r.member: (r.fields, (r.error or "").split(":")[0]) for r in read_members(spark, str(tmp_path)).collect()}
    assert got["good.txt"] == (["1", "2"], "")
    assert {m: e for m, (_, e) in got.items() if e} == {
        "other.txt": "KeyError", "broken.txt": "BadZipFile", "bent.txt": "BadZipFile", "lzma.txt": "NotImplementedError"}
    assert dv.device_documents(read_members(spark, str(tmp_path))).count() == 0


def test_empty_folder(spark, tmp_path):
    assert read_members(spark, f"file://{tmp_path}").collect() == []
    with pytest.raises(Exception):
        read_members(spark, f"{tmp_path}/missing").collect()


def test_small_members_share_a_partition():
    sizes = [5, 5, 1, 30, 2, 2, 40]
    parts = shared([Member("p", str(i), packed=n) for i, n in enumerate(sizes)], 10)
    assert [[m.packed for m in p.members] for p in parts] == [[5, 5], [1], [30], [2, 2], [40]]
