"""Message logs: (topic, partition, offset, timestamp, key, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import fill_key

MESSAGE_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
)
ARRIVAL = ["timestamp", "partition", "offset"]


def log_options(
    brokers: str | list[str],
    topics: str | list[str],
    from_beginning: bool = False,
    starting_offsets: str | None = None,
    max_per_trigger: int | None = None,
    group_prefix: str | None = None,
) -> dict[str, str]:
    """Reader options of a message log. A checkpoint, where there is one, decides
    over the starting position, so it takes the place of stored group offsets."""
    joined = [",".join(x) if isinstance(x, (list, tuple)) else x for x in (brokers, topics)]
    options = {
        "kafka.bootstrap.servers": joined[0],
        "subscribe": ",".join(t.strip() for t in joined[1].split(",") if t.strip()),
        "startingOffsets": starting_offsets or ("earliest" if from_beginning else "latest"),
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if group_prefix:
        options["groupIdPrefix"] = group_prefix
    return options


def read_log(
    spark: SparkSession, options: dict[str, str], streaming: bool = True, format: str = "kafka"
) -> DataFrame:
    """Message rows of a log. Needs the connector of ``format`` on the class path."""
    if not streaming and options.get("startingOffsets") == "latest":
        raise ValueError("a batch read cannot start at the latest offset: pass from_beginning or starting_offsets")
    reader = spark.readStream if streaming else spark.read
    return reader.format(format).options(**options).load()


def read_message_files(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: str = MESSAGE_SCHEMA,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same rows kept as files: an archived log, or a test."""
    reader = (spark.readStream if streaming else spark.read).format(format).schema(schema)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def text_lines(messages: DataFrame, line: str = "line") -> DataFrame:
    """Message rows with the value as text."""
    rest = [c for c in messages.columns if c not in ("key", "value")]
    return messages.select(*rest, F.col("key").cast("string"), F.col("value").cast("string").alias(line))


def fill_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines as messages for the bulk load: key is the first bytes of the line."""
    return lines.select(fill_key(line).alias("key"), F.encode(line, "UTF-8").alias("value"))


def topic_metrics(messages: DataFrame) -> DataFrame:
    """Per topic partition: current offset, bytes and messages received."""
    return messages.groupBy("topic", "partition").agg(
        F.max("offset").alias("current_offset"),
        F.sum(F.octet_length("value")).alias("bytes"),
        F.count("*").alias("messages"),
    )


def sampled_messages(messages: DataFrame, every: int = 100_000) -> DataFrame:
    """Every n-th message of each topic partition, to look at."""
    return messages.where(F.pmod("offset", F.lit(every)) == 0)
