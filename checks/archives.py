"""Archives made from the given tables, to read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.sources.archive_members import opened


def pack_records(
    lines: DataFrame, archive: str, order: str, header: str, line: str = "line"
) -> DataFrame:
    """One archive (path, content) per value of ``archive``, holding its lines in ``order``."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        path = group["path"].iloc[0]
        member = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".txt"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open(member, "w") as out:
                out.write((header + "\n").encode())
                for text in group.sort_values("ord")["line"]:
                    out.write((text + "\n").encode())
        return pd.DataFrame({"path": [path], "content": [buffer.getvalue()]})

    rows = lines.select(F.col(archive).alias("path"), F.col(order).alias("ord"), F.col(line).alias("line"))
    return rows.groupBy("path").applyInPandas(pack, "path string, content binary")


def write_archives(
    lines: DataFrame, folder: str, archive: str, member: str, order: str, header: str, line: str = "line"
) -> int:
    """Archives in a folder that executors share, one file per value of ``archive`` with a
    text member per value of ``member``; gives back how many. An archive is one task, as
    a zip file is written from front to back; it goes out member by member."""

    def write(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        files, root = opened(folder)
        files.create_dir(root)
        rows = pd.concat(groups)
        with files.open_output_stream(f"{root}/{key[0]}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, texts in rows.sort_values("ord").groupby("member"):
                z.writestr(name, "\n".join([header, *texts["line"], ""]))
        yield pd.DataFrame({"archive": [key[0]]})

    rows = lines.select(
        F.col(archive).alias("archive"), F.col(member).alias("member"), F.col(order).alias("ord"), F.col(line).alias("line")
    )
    return rows.groupBy("archive").applyInPandas(write, "archive string").count()
