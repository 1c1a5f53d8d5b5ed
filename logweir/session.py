"""Session helpers: the shared folder for cut lineage, and a local session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "logweir", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench (a cluster brings its own)."""
    threads = (os.cpu_count() or 8) if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a fresh temporary folder.
    On a cluster that would be a different disk on every machine, so it is an
    error there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="logweir-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/logweir/{label}-{uuid.uuid4().hex}"


_written: dict[str, list[str]] = {}


def written_table(df: DataFrame, label: str, owned: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage the way ``checkpoint()`` does, survives lost executors, and
    unlike a checkpoint is columnar: later passes read only their columns.
    A caller that passes ``owned`` gets the path there and deletes it itself
    (``drop_paths``); other tables stay until ``drop_written``.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    kept = _written.setdefault(df.sparkSession.sparkContext.applicationId, []) if owned is None else owned
    kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that this application wrote with ``written_table`` so far
    and that no caller owns, once the results that read them are stored. Returns
    how many there were."""
    return drop_paths(spark, _written.get(spark.sparkContext.applicationId, []))


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete these folders and empty the list."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        dropped += path.getFileSystem(conf).delete(path, True)
    return dropped
