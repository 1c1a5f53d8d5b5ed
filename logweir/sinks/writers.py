"""Message-log and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def write_log(
    messages: DataFrame,
    topic: str | None = None,
    format: str = "kafka",
    checkpoint: str | None = None,
    available_now: bool = False,
    **options: str,
) -> StreamingQuery | None:
    """Write (key, value) rows to a message log, in batch or as a stream.

    Delivery is at least once: a retried task sends again, so readers dedupe by
    key. A stream restarts from its ``checkpoint``.
    """
    rows = messages.select(
        F.col("key").cast("string"), F.col("value").cast("string")
    )
    if topic:
        options["topic"] = topic
    if not messages.isStreaming:
        rows.write.format(format).options(**options).mode("append").save()
        return None
    if checkpoint is None:
        raise ValueError("a streaming write needs a checkpoint folder")
    writer = rows.writeStream.format(format).options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV files with a header, sorted across files by ``order``."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
