"""Zipped delimited files, one text member per archive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import member_name

RECORD_SCHEMA = "path string, member string, record_no bigint, fields array<string>, error string"


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_archives(
    spark: SparkSession, folder: str, glob: str = "*.zip", streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """path, content of the archives below a folder; as a stream, of those that arrive."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").schema(FILE_SCHEMA)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (
        reader.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "content")
    )


def unpack_records(archives: DataFrame, sep: str = "|", rows_per_batch: int = 10_000) -> DataFrame:
    """Records of the member named like the archive, header skipped.

    A deflated member can only be read from its start, so an archive is the unit
    of work; it is read as a stream and handed on in batches. An archive or a
    record that cannot be read gives a row with ``error`` and no fields.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        import sys
        import zipfile

        csv.field_size_limit(sys.maxsize)

        def records(content: bytes, member: str):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as raw:
                    text = io.TextIOWrapper(raw, "utf-8", errors="replace", newline="")
                    reader = csv.reader(text, delimiter=sep)
                    next(reader, None)
                    number = 0
                    while True:
                        number += 1
                        try:
                            yield number, next(reader), None
                        except StopIteration:
                            return
                        except csv.Error as e:
                            yield number, None, str(e)
            except (zipfile.BadZipFile, KeyError, OSError, EOFError) as e:
                yield 0, None, f"{type(e).__name__}: {e}"

        columns = ["path", "member", "record_no", "fields", "error"]
        for batch in batches:
            for path, member, content in zip(batch["path"], batch["member"], batch["content"]):
                rows = []
                for number, fields, error in records(content, member):
                    rows.append((path, member, number, fields, error))
                    if len(rows) == rows_per_batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    named = archives.select("path", member_name("path").alias("member"), F.col("content"))
    return named.mapInPandas(unpack, RECORD_SCHEMA)
