"""The metric report end to end: log files in folders with awkward names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.operators.metrics import HARDWARE_COLUMNS
from logweir.plans import jobs
from logweir.session import fresh_folder

from . import lines as L
from .metric_queries import HW, HW_S, LAT, THR
from .registry import query

#: In the order of their labels: a blank, two that give one label, a percent sign, no digits.
FOLDERS = ["1 node", "10-0-0-1", "10.0.0.1", "50%x", "plain"]
KINDS = {
    "latency": (L.LATENCY_TEXT, "x_latencies_1.txt", ["second", "p50", "p999"]),
    "throughput": (L.THROUGHPUT_TEXT, "incoming_throughput.txt", ["second", "qps"]),
    "hardware": (L.HARDWARE_TEXT, "hardware_usage.txt", ["second", *HARDWARE_COLUMNS]),
}


def write_logs(spark: SparkSession, sf_dir: str) -> str:
    """All metric lines of the events table, dealt to one file per folder and kind."""
    folder = fresh_folder(spark, "metric-logs")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for k, name in enumerate(FOLDERS):
        for text, file, _ in KINDS.values():
            rows = L.events(spark, sf_dir, text).where(F.col("event_id") % len(FOLDERS) == k)
            staged = f"{folder}-staged/{k}/{file}"
            rows.coalesce(1).sortWithinPartitions("event_id").select("line").write.text(staged)
            source = hadoop.Path(staged)
            fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
            fs.mkdirs(hadoop.Path(folder, name))
            fs.rename(part, hadoop.Path(hadoop.Path(folder, name), file))
    return folder


def _sql() -> str:
    tables = [
        ("latency", "l", "SELECT event_id % 5 AS node, second_s, floor(avg(p50))::bigint AS p50, floor(avg(p999))::bigint AS p999 FROM lat GROUP BY 1, 2"),
        ("throughput", "t", "SELECT event_id % 5 AS node, second_s, sum(qps)::bigint AS qps FROM thr GROUP BY 1, 2"),
        ("hardware", "h", "SELECT node, second_s, " + ", ".join(HARDWARE_COLUMNS) + " FROM hw_s"),
    ]
    hw_s = HW_S.replace("SELECT second_s, avg(cpu1)", "SELECT event_id % 5 AS node, second_s, avg(cpu1)").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace(
        "hw_s AS (SELECT second_s", "hw_s AS (SELECT node, second_s"
    )
    placed = ", ".join(f"{n} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY second_s) - 1 AS i FROM ({body}))" for _, n, body in tables)
    columns, joins = [], []
    for kind, n, _ in tables:
        for k in range(len(FOLDERS)):
            joins.append(f"LEFT JOIN {n} AS {n}{k} ON {n}{k}.node = {k} AND {n}{k}.i = s.i")
            for c in KINDS[kind][2]:
                columns.append(f"{n}{k}.{'second_s' if c == 'second' else c} AS {kind}_{k}_{c}")
    spine = " UNION ".join(f"SELECT i FROM {n}" for _, n, _ in tables)
    return f"WITH {LAT}, {THR}, {HW}, {hw_s}, {placed} SELECT s.i AS row_idx, {', '.join(columns)} FROM ({spine}) AS s {' '.join(joins)}"


@query("metric_report", _sql())
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns are named by the place of their folder, as labels hold the folder's path."""
    report = jobs.metric_report(spark, write_logs(spark, sf_dir))
    names = [(kind, k, c) for kind, (_, _, columns) in KINDS.items() for k in range(len(FOLDERS)) for c in columns]
    out = report.toDF("row_idx", *[f"{kind}_{k}_{c}" for kind, k, c in names])
    return out.select(
        F.col("row_idx").cast("bigint"),
        *[F.unix_seconds(n).alias(n) if c == "second" else F.col(n) for (kind, k, c) in names for n in [f"{kind}_{k}_{c}"]],
    )
