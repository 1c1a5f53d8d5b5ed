from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import alignment as al, metrics as mt
from logweir.operators.parsing import parse_hardware, parse_latency, parse_throughput
from logweir.plans import jobs
from logweir.session import fresh_folder
from logweir.sinks.writers import write_report
from logweir.sources.files import any_case, read_metric_lines


def hardware(second, cpu, total, free, fraction=0):
    return (f"[2016-04-06 {second}.{fraction:03d}] [hardware_usage_monitor] [info] cpu 1min: {cpu}, cpu 5min: 0.50, "
            f"cpu 15min: 0.10, total mem: {total}, free mem: {free}, shared mem: 0.001 KB")


def latency(second, p50, p999):
    return f"[2016-04-06 {second}.001] [x] [info] p50: {p50}us, p95: 1us, p99: 1us, p999: {p999}us"


def throughput(second, n):
    return f"[2016-04-06 {second}.001] [incoming_throughput] [info] {n} req in 1000us. total: 5 req"


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, line string")


def test_latency_means_are_cut(spark, rows):
    parsed = parse_latency(lines(spark, [latency("00:00:01", 10, 7), latency("00:00:01", 13, 8), latency("23:59:59", 1, 2)]))
    out = mt.latency_by_second(parsed)
    assert rows(mt.as_sheet(out)) == [("2016-4-6", "0:0:1", 11, 7), ("2016-4-6", "23:59:59", 1, 2)]


def test_throughput_sums(spark, rows):
    parsed = parse_throughput(lines(spark, [throughput("10:00:00", 5), throughput("10:00:00", 7), throughput("10:00:01", 1)]))
    assert [r[1] for r in rows(mt.throughput_by_second(parsed))] == [12, 1]


def test_hardware_takes_total_of_last_line(spark):
    texts = [hardware("10:00:00", "0.20", "30.000 GB", "10.000 GB"), hardware("10:00:00", "0.40", "40.000 GB", "5120.000 MB")]
    for order in (["pos"], ["second", "pos"]):
        row = mt.hardware_by_second(parse_hardware(lines(spark, texts)), order).head()
        assert tuple(row)[1:] == (0.3, 0.5, 7.5, 32.5, 81.25)


def test_hardware_without_memory(spark):
    row = mt.hardware_by_second(parse_hardware(lines(spark, [hardware("10:00:00", "0.20", "0.0 GB", "0.0 GB")])), ["pos"]).head()
    assert row.percentage_used is None


def test_align(spark, rows):
    lat = parse_latency(lines(spark, [latency("10:00:00", 4, 8)]))
    thr = parse_throughput(lines(spark, [throughput("10:00:00", 5), throughput("10:00:02", 6)]))
    hw = parse_hardware(lines(spark, [hardware("10:00:01", "0.20", "4.0 GB", "1.0 GB")]))
    out = al.align_by_second(lat, thr, hw, ["pos"])
    got = rows(out.select(F.second("second"), "p50", "p999", "qps", "cpu1", "free_mem_gb", "percentage_used"))
    assert got == [(0, 4, 8, 5, None, None, None), (1, None, None, None, 0.2, 1.0, 75.0), (2, None, None, 6, None, None, None)]


def model_zip(tables, stop):
    """Read all tables line by line; stop once at most one still gives lines."""
    out, t = [], 0
    while True:
        row = [table[t] if t < len(table) else None for table in tables]
        out.append(row)
        left = len(tables) - 1 - sum(v is None for v in row)
        t += 1
        if stop and left <= 0:
            return out
        if not stop and all(t >= len(table) for table in tables):
            return out


@pytest.mark.parametrize("stop", [None, "second_longest"])
@pytest.mark.parametrize("sizes", [(3,), (4, 2), (3, 3), (5, 1, 3), (2, 5, 5), (0, 4), (6, 0, 0), (1, 2, 3, 9)])
def test_zip(spark, sizes, stop):
    draw = random.Random(sum(sizes))
    data = [sorted(draw.sample(range(100), n)) for n in sizes]
    tables = {
        f"t{i}": spark.createDataFrame([(v, f"{v}") for v in column], "at bigint, name string")
        for i, column in enumerate(data)
    }
    out = al.zip_by_position(tables, ["at"], stop).orderBy("row_idx").collect()
    names = [f"t{i}_at" for i in range(len(sizes))]
    assert [[r[n] for n in names] for r in out] == model_zip(data, stop)
    assert [r.row_idx for r in out] == list(range(len(out)))


def test_unknown_stop(spark):
    with pytest.raises(ValueError):
        al.zip_by_position({"a": spark.range(1)}, ["id"], "never")


@pytest.fixture
def metric_folder(tmp_path):
    for node in (1, 2):
        folder = tmp_path / "run" / f"10.0.0.{node}"
        folder.mkdir(parents=True)
        (folder / "Principal_Latencies_1.txt").write_text("\n".join(latency("10:00:00", 10 * node, 20)for _ in range(2)) + "\n")
        (folder / "principal_latencies_2.txt").write_text(latency("10:00:01", 7, 9) + "\nnoise\n")
        (folder / "incoming_throughput.txt").write_text(throughput("10:00:00", node) + "\n")
        (folder / "hardware_usage.txt").write_text(
            hardware("10:00:00", "0.20", "8.0 GB", "4.0 GB") + "\n" + hardware("10:00:00", "0.20", "16.0 GB", "4.0 GB") + "\n")
        (folder / "other.log").write_text("x\n")
    return str(tmp_path)


def test_metric_files(spark, metric_folder):
    assert any_case("*a.txt") == "*[aA].[tT][xX][tT]"
    assert read_metric_lines(spark, metric_folder, "latency").count() == 8
    assert read_metric_lines(spark, metric_folder, "throughput").count() == 2


def test_metric_report(spark, metric_folder, tmp_path):
    report = jobs.metric_report(spark, metric_folder)
    got = report.collect()
    assert [r.row_idx for r in got] == [0, 1]
    by_kind = {k: [c for c in report.columns if c.startswith(k)] for k in ("latency", "throughput", "hardware")}
    assert {k: len(v) for k, v in by_kind.items()} == {"latency": 6, "throughput": 4, "hardware": 12}
    p50 = [c for c in by_kind["latency"] if c.endswith("p50")]
    assert [[r[c] for c in p50] for r in got] == [[10, 20], [7, 7]]
    used = [c for c in by_kind["hardware"] if c.endswith("used_mem_gb")]
    assert [got[0][c] for c in used] == [12.0, 12.0] and [got[1][c] for c in used] == [None, None]
    write_report(report, f"{fresh_folder(spark, 'report')}", ["row_idx"])


def test_report_keeps_every_folder(spark, tmp_path):
    """Names that file metadata escapes, and names that give one label."""
    nodes = ["2 node", "1node", "50%x", "10.0.0.1", "10-0-0-1", "a+b"]
    for k, name in enumerate(nodes):
        folder = tmp_path / "logs" / name
        folder.mkdir(parents=True)
        (folder / "x_latencies.txt").write_text(latency("10:00:00", 10 * k + 1, 5) + "\n" + latency("10:00:01", 10 * k + 2, 5) + "\n")
    report = jobs.metric_report(spark, str(tmp_path / "logs"))
    got = report.orderBy("row_idx").collect()
    columns = [c for c in report.columns if c.endswith("_p50")]
    assert len(columns) == len(set(columns)) == len(nodes)
    assert sorted(tuple(r[c] for r in got) for c in columns) == sorted((10 * k + 1, 10 * k + 2) for k in range(len(nodes)))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session_zone(spark, zone):
    from logweir.functions.columns import iso_time, sheet_date, sheet_time, utc_second

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        seconds = [0, -1, 1457836200, 1457839800, 1704068534, 1478408400, 951782400]  # clocks change in two of them
        rows = spark.createDataFrame([(s,) for s in seconds], "s bigint").select(
            "s", iso_time("s").alias("iso"), sheet_date(F.timestamp_seconds("s")).alias("d"), sheet_time(F.timestamp_seconds("s")).alias("t")
        ).collect()
        for r in rows:
            at = datetime.datetime.fromtimestamp(r.s, datetime.timezone.utc)
            assert r.iso == at.strftime("%Y-%m-%dT%H:%M:%SZ")
            assert r.d == f"{at.year:04d}-{at.month}-{at.day}" and r.t == f"{at.hour}:{at.minute}:{at.second}"
        local = spark.createDataFrame([(datetime.datetime.fromtimestamp(s, datetime.timezone.utc).replace(tzinfo=None),) for s in seconds], "t timestamp_ntz")
        got = sorted(tuple(r) for r in local.select(sheet_date("t"), sheet_time("t")).collect())
        assert got == sorted((r.d, r.t) for r in rows)
        texts = spark.createDataFrame([("2016-03-13 02:30:00",), ("2016-03-13 03:30:00",), ("2016-02-30 00:00:00",)], "x string")
        got = [r[0] for r in texts.select(F.unix_seconds(utc_second(F.col("x")))).collect()]
        assert got == [1457836200, 1457839800, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_report_files_are_sorted(spark):
    path = fresh_folder(spark, "sheet")
    write_report(spark.range(1000).select((999 - F.col("id")).alias("second")), path, ["second"])
    import glob
    texts = [open(p).read().split() for p in sorted(glob.glob(f"{path}/part-*"))]
    assert all(t[0] == "second" for t in texts if t)
    assert [int(x) for t in texts for x in t[1:]] == list(range(1000))
