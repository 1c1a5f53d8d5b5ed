from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweir.functions import columns as C
from logweir.operators import parsing as ps
from logweir.plans import jobs

HEAD = "- 1102809860 2004.12.11 server2 Dec 11 16:04:20 "
GOOD = HEAD + "src@ladmin2 kernel: IRQ 17 handled"


def parsed(spark, parser, text, **options):
    out = parser(spark.createDataFrame([(text,)], "line string"), **options).drop("line").collect()
    return out[0].asDict() if out else None


# line, date line parses, event line (user, sep, node, msg), payload found
EDGES = {
    "sample": (GOOD, True, ("src", "@", "ladmin2", "kernel: IRQ 17 handled"), True),
    "no separator": (HEAD + "server2 kernel: hi", True, ("serve", "r", "2", "kernel: hi"), True),
    "blank as separator": (HEAD + "server2 kernel up now", True, ("server2", " ", "kernel", "up now"), True),
    "padded day": ("- 1102809860 2004.12.01 server2 Dec  1 16:04:20 a@b x", False, None, False),
    "alert tag": ("ALERT" + GOOD[1:], False, None, False),
    "text before": ("x " + GOOD, False, None, True),
    "dash in node": (GOOD.replace("server2", "ln-1"), False, ("src", "@", "ladmin2", "kernel: IRQ 17 handled"), False),
    "dash in user node": (HEAD + "src@ladmin-2 kernel: x", True, None, True),
    "slash": (HEAD + "dn228/dn228 kernel: x", True, ("dn228", "/", "dn228", "kernel: x"), True),
    "empty payload": (HEAD + "a@b ", True, ("a", "@", "b", ""), True),
    "not a line": ("", False, None, False),
    "number too big": (GOOD.replace("1102809860", "9" * 25), True, None, False),
    "year too big": (GOOD.replace("2004.", "99999999999."), False, ("src", "@", "ladmin2", "kernel: IRQ 17 handled"), True),
    "carriage return inside": (GOOD + "\rtail", True, ("src", "@", "ladmin2", "kernel: IRQ 17 handled\rtail"), True),
    "mark as separator": (HEAD + "a\u0001b c", True, ("a", "\u0001", "b", "c"), True),
    "mark in payload": (HEAD + "a@b c\u0001d\u0001", True, ("a", "@", "b", "c\u0001d\u0001"), True),
    "only marks": ("\u00011\u00012\u00013\u0001x", False, None, False),
    "wide separator": (HEAD + "a\U0001F600b c", True, ("a", "\U0001F600", "b", "c"), True),
    "dollar and backslash": (HEAD + r"a@b $1 \1", True, ("a", "@", "b", r"$1 \1"), True),
}


@pytest.mark.parametrize("case", EDGES)
def test_edges(spark, case):
    line, date_ok, event, found = EDGES[case]
    assert (parsed(spark, ps.parse_date, line) is not None) == date_ok
    got = parsed(spark, ps.parse_event, line)
    assert (got and tuple(got[k] for k in ("username", "sep", "nodename", "msg"))) == event
    assert (parsed(spark, ps.parse_payload, line) is not None) == found
    for fmt, ok in (("date", date_ok), ("event", event is not None), ("payload_found", found)):
        frame = spark.createDataFrame([(line,)], "line string")
        assert ps.with_parse_flag(frame, fmt).head().parsed == ok
        assert ps.rejected_lines(frame, fmt).count() == (0 if ok else 1)


def test_fields(spark):
    assert parsed(spark, ps.parse_date, GOOD) == {
        "year": 2004, "month": 12, "day": 11, "msg": "src@ladmin2 kernel: IRQ 17 handled"[len("src@ladmin2 "):]}
    both = parsed(spark, ps.parse_dated, GOOD)
    assert (both["epoch_s"], both["year"], both["day"]) == (1102809860, 2004, 11)
    found = parsed(spark, ps.parse_payload, "junk - 5 - " + GOOD[2:])
    assert found == {"epoch_s": 1102809860, "msg": "kernel: IRQ 17 handled"}
    assert parsed(spark, ps.parse_payload, "x " + GOOD, anchored=True) is None


def test_strict_separator(spark):
    got = parsed(spark, ps.parse_event, HEAD + "server2 kernel up", strict_sep=True)
    assert (got["username"], got["sep"], got["nodename"], got["msg"]) == (None, None, "server2", "kernel up")
    got = parsed(spark, ps.parse_event, GOOD, strict_sep=True)
    assert (got["username"], got["sep"], got["nodename"]) == ("src", "@", "ladmin2")
    frame = spark.createDataFrame([(HEAD + "server2 IRQ",)], "line string")
    value = jobs.match(frame, strict_sep=True, processed=F.lit("T")).head().value
    assert value == "T:2004-12-12T00:04:20Z:server2:IRQ"


def test_metric_lines(spark):
    latency = ("[2016-04-06 21:19:21.549] [principal_latencies] [info] 127.0.0.1:31002: traceId: -2823056735374592900, "
               "parentId: 4410988282745891113, id: -307255297444731547, p50: 483us, p95: 963us, p99: 1094us, p999: 1896us")
    got = parsed(spark, ps.parse_latency, latency)
    assert (str(got["second"]), got["p50"], got["p999"]) == ("2016-04-06 21:19:21", 483, 1896)
    got = parsed(spark, ps.parse_throughput,
                 "[2016-04-06 00:10:58.196] [incoming_throughput] [info] 43240 req in 1001098us. total: 2068663 req")
    assert (str(got["second"]), got["qps"], got["duration_us"]) == ("2016-04-06 00:10:58", 43240, 1001098)
    got = parsed(spark, ps.parse_hardware,
                 "[2016-04-06 21:19:22.255] [hardware_usage_monitor] [info] cpu 1min: 0.21, cpu 5min: 0.17, "
                 "cpu 15min: 0.10, total mem: 29.453 GB, free mem: 505.5 MB, shared mem: 0.001 KB")
    assert (got["cpu1"], got["cpu5"]) == (0.21, 0.17)
    assert got["total_mem"] == 29.453 * 2**30 and got["free_mem"] == 505.5 * 2**20
    assert parsed(spark, ps.parse_latency, latency.replace("04-06", "13-06")) is None
    assert parsed(spark, ps.parse_throughput, latency) is None


def test_scalars(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).head()[0]

    assert value(C.iso_time(F.lit(1102809860))) == "2004-12-12T00:04:20Z"
    assert value(C.sheet_date(F.timestamp_seconds(F.lit(1102809860)))) == "2004-12-12"
    assert value(C.sheet_time(F.timestamp_seconds(F.lit(1102809860)))) == "0:4:20"
    assert value(C.month_key(F.lit("07"), F.lit("2004"))) == "7-2004"
    assert [value(C.unit_bytes(F.lit(2.0), F.lit(u))) for u in ("KB", "MB", "GB", "TB")] == [2**11, 2**21, 2**31, 2]
    assert value(C.member_name(F.lit("http://x/a.b/pma96.cur.zip"))) == "pma96.cur.txt"
    assert value(C.tokens(F.lit(" a  b "))) == ["a", "b"]
    labels = {
        "/data/2016-04-06/10.0.0.1/run:a/x.csv": "2016_04_0610_0_0_1run_ax_csv",
        "run-1/node.csv": "run_1_node_csv",
        "7/x": "7x",
        "./-a": "a",
    }
    assert {k: value(C.source_label(F.lit(k))) for k in labels} == labels
    # bytes, not characters: 24 bytes end inside the 12th two-byte letter's successor
    assert bytes(value(C.fill_key(F.lit("é" * 20)))) == ("é" * 20).encode()[:24]
    assert bytes(value(C.fill_key(F.lit("short")))) == b"short"


def test_match_scopes(spark, rows):
    lines = [GOOD, HEAD + "IRQ@node kernel: quiet", HEAD + "a@b irq", "IRQ not a line"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert ps.matching(frame).count() == 1
    assert ps.matching(frame, scope="line").count() == 2
    with pytest.raises(ValueError):
        ps.matching(frame, scope="word")
    out = jobs.match(frame, processed=F.lit("P"))
    assert rows(out, "value") == [("P:2004-12-12T00:04:20Z:src@ladmin2:kernel: IRQ 17 handled",)]
    assert dict(out.dtypes)["key"] == "bigint"


def test_regex_runs_once_per_line(spark):
    """The match, the reject filter and all fields share one regex evaluation."""
    frame = spark.createDataFrame([(GOOD,)], "line string")
    plan = ps.parse_event(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
