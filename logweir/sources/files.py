"""Line files: logs, words, metric logs, and tables kept as parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# File names of the three kinds of metric logs, in any case.
METRIC_FILES = {
    "latency": "*latencies*.txt",
    "throughput": "*throughput.txt",
    "hardware": "hardware*.txt",
}


def any_case(glob: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in glob)


def read_lines(spark: SparkSession, path: str | list[str], line: str = "line") -> DataFrame:
    """One row per line."""
    return spark.read.text(path).select(F.col("value").alias(line))


def read_words(
    spark: SparkSession, path: str, sep: str = ",", streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """One row per word of delimiter-separated files; splits big files too."""
    reader = (spark.readStream if streaming else spark.read).option("lineSep", sep)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(F.col("value").alias("word"))


def plain_path() -> Column:
    """Path of the file a row was read from, as it is named: file metadata has it with
    blanks and the like escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_metric_lines(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Lines of all metric logs of a kind below ``folder``.

    ``path`` says where a line stood; (path, block, pos) is its place: blocks of
    a file are read whole by one task each, in order.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case(METRIC_FILES[kind]))
        .text(folder)
    )
    return lines.select(
        F.col("value").alias("line"),
        plain_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def metric_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Paths of the metric logs of a kind; only lists them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case(METRIC_FILES[kind]))
        .load(folder)
        .select(plain_path().alias("path"))
    )


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isDirectory()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(
    spark: SparkSession, folder: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet table as a file stream, kept as one file or as a folder of parts."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(read_table(spark, folder, name).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    # a file stream opens folders only: take the one file of this name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
