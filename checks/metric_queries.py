"""Metric lines: parsing, roll-ups per second, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.functions import columns as C, patterns as P
from logweir.operators import alignment as al, metrics as mt
from logweir.operators.parsing import parse_hardware, parse_latency, parse_throughput

from . import lines as L
from .parsing_queries import group, whole
from .registry import query

RL, RT, RH = whole(P.LATENCY_LINE), whole(P.THROUGHPUT_LINE), whole(P.HARDWARE_LINE)


def second(pattern: str) -> str:
    return f"cast(epoch({group(1, pattern)}::timestamp) AS BIGINT) AS second_s"


def in_bytes(n: int, unit: int) -> str:
    return f"""({group(n, RH)}::double * CASE {group(unit, RH)} WHEN 'GB' THEN 1073741824.0 WHEN 'MB' THEN 1048576.0
 WHEN 'KB' THEN 1024.0 ELSE 1.0 END)"""


LAT = f"""lat AS (SELECT event_id, {second(RL)}, {group(2, RL)}::bigint AS p50, {group(3, RL)}::bigint AS p999
 FROM ({L.duck_events(L.DUCK_LATENCY_TEXT)}) WHERE regexp_matches(line, '{RL}'))"""
THR = f"""thr AS (SELECT event_id, {second(RT)}, {group(2, RT)}::bigint AS qps, {group(3, RT)}::bigint AS duration_us
 FROM ({L.duck_events(L.DUCK_THROUGHPUT_TEXT)}) WHERE regexp_matches(line, '{RT}'))"""
HW = f"""hw AS (SELECT event_id, {second(RH)}, {group(2, RH)}::double AS cpu1, {group(3, RH)}::double AS cpu5,
 {in_bytes(4, 5)} AS total_mem, {in_bytes(6, 7)} AS free_mem
 FROM ({L.duck_events(L.DUCK_HARDWARE_TEXT)}) WHERE regexp_matches(line, '{RH}'))"""
LAT_S = "lat_s AS (SELECT second_s, floor(avg(p50))::bigint AS p50, floor(avg(p999))::bigint AS p999 FROM lat GROUP BY 1)"
THR_S = "thr_s AS (SELECT second_s, sum(qps)::bigint AS qps FROM thr GROUP BY 1)"
HW_S = """hw_a AS (SELECT second_s, avg(cpu1) AS c1, avg(cpu5) AS c5, avg(free_mem) AS f, arg_max(total_mem, event_id) AS t
 FROM hw GROUP BY 1), hw_s AS (SELECT second_s, round(c1, 4) AS cpu1, round(c5, 4) AS cpu5,
 round(f / 1073741824.0, 4) AS free_mem_gb, round((t - f) / 1073741824.0, 4) AS used_mem_gb,
 round((t - f) / t * 100.0, 4) AS percentage_used FROM hw_a)"""


def in_seconds(df):
    rest = [c for c in df.columns if c != "second"]
    return df.select(F.unix_seconds("second").alias("second_s"), *rest)


def latency(spark, sf_dir):
    return parse_latency(L.events(spark, sf_dir, L.LATENCY_TEXT)).drop("line")


def throughput(spark, sf_dir):
    return parse_throughput(L.events(spark, sf_dir, L.THROUGHPUT_TEXT)).drop("line")


def hardware(spark, sf_dir):
    return parse_hardware(L.events(spark, sf_dir, L.HARDWARE_TEXT)).drop("line")


@query("parse_latency", f"WITH {LAT} SELECT * FROM lat")
def q_parse_latency(spark, sf_dir):
    return in_seconds(latency(spark, sf_dir))


@query("parse_throughput", f"WITH {THR} SELECT * FROM thr")
def q_parse_throughput(spark, sf_dir):
    return in_seconds(throughput(spark, sf_dir))


@query("parse_hardware", f"WITH {HW} SELECT * FROM hw")
def q_parse_hardware(spark, sf_dir):
    return in_seconds(hardware(spark, sf_dir))


@query("unit_bytes", """SELECT event_id, "value" * CASE user_id % 4 WHEN 0 THEN 1073741824.0 WHEN 1 THEN 1048576.0
 WHEN 2 THEN 1024.0 ELSE 1.0 END AS bytes FROM events""")
def unit_bytes(spark, sf_dir):
    unit = "element_at(array('GB', 'MB', 'KB', 'TB'), cast(user_id % 4 as int) + 1) as unit"
    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "value", unit)
    return rows.select("event_id", C.unit_bytes("value", "unit").alias("bytes"))


@query("latency_by_second", f"WITH {LAT}, {LAT_S} SELECT * FROM lat_s")
def latency_by_second(spark, sf_dir):
    return in_seconds(mt.latency_by_second(latency(spark, sf_dir)))


@query("throughput_by_second", f"WITH {THR}, {THR_S} SELECT * FROM thr_s")
def throughput_by_second(spark, sf_dir):
    return in_seconds(mt.throughput_by_second(throughput(spark, sf_dir)))


@query("hardware_by_second", f"WITH {HW}, {HW_S} SELECT * FROM hw_s")
def hardware_by_second(spark, sf_dir):
    return in_seconds(mt.hardware_by_second(hardware(spark, sf_dir), ["event_id"]))


@query("latency_sheet", f"""WITH {LAT}, {LAT_S}, s AS (SELECT *, make_timestamp(second_s*1000000) AS t FROM lat_s)
SELECT year(t)||'-'||month(t)||'-'||day(t) AS date, hour(t)||':'||minute(t)||':'||second(t) AS time, p50, p999 FROM s""")
def latency_sheet(spark, sf_dir):
    return mt.as_sheet(mt.latency_by_second(latency(spark, sf_dir)))


@query("align_by_second", f"""WITH {LAT}, {LAT_S}, {THR}, {THR_S}, {HW}, {HW_S}
SELECT second_s, p50, p999, qps, cpu1, cpu5, free_mem_gb, used_mem_gb, percentage_used
FROM lat_s FULL JOIN thr_s USING (second_s) FULL JOIN hw_s USING (second_s)""")
def align_by_second(spark, sf_dir):
    return in_seconds(al.align_by_second(
        latency(spark, sf_dir), throughput(spark, sf_dir), hardware(spark, sf_dir), ["event_id"]))


def placed(table: str, columns: list[str]) -> str:
    label = table.removesuffix("_s")
    names = ", ".join(f"{c} AS {label}_{c}" for c in columns)
    return f"{label}_p AS (SELECT row_number() OVER (ORDER BY second_s) - 1 AS row_idx, {names} FROM {table})"


ZIPPED = f"""WITH {LAT}, {LAT_S}, {THR}, {THR_S}, {HW}, {HW_S}, {placed('lat_s', ['second_s', 'p50', 'p999'])},
 {placed('thr_s', ['second_s', 'qps'])}, {placed('hw_s', ['second_s', 'cpu1', 'percentage_used'])},
 z AS (SELECT * FROM lat_p FULL JOIN thr_p USING (row_idx) FULL JOIN hw_p USING (row_idx))"""


def _tables(spark, sf_dir):
    hw = mt.hardware_by_second(hardware(spark, sf_dir), ["event_id"])
    return {
        "lat": in_seconds(mt.latency_by_second(latency(spark, sf_dir))),
        "thr": in_seconds(mt.throughput_by_second(throughput(spark, sf_dir))),
        "hw": in_seconds(hw).select("second_s", "cpu1", "percentage_used"),
    }


@query("zip_by_position", f"{ZIPPED} SELECT * FROM z")
def zip_by_position(spark, sf_dir):
    return al.zip_by_position(_tables(spark, sf_dir), ["second_s"])


@query("zip_by_position_cut", f"""{ZIPPED}, n AS (SELECT unnest([(SELECT count(*) FROM lat_s), (SELECT count(*) FROM thr_s),
 (SELECT count(*) FROM hw_s)]) AS rows)
SELECT * FROM z WHERE row_idx <= (SELECT rows FROM n ORDER BY rows DESC LIMIT 1 OFFSET 1)""")
def zip_by_position_cut(spark, sf_dir):
    return al.zip_by_position(_tables(spark, sf_dir), ["second_s"], stop="second_longest")


@query("source_label", f"""WITH p AS (SELECT event_id, {L.DUCK_PATH_TEXT} AS path FROM events),
 q AS (SELECT event_id, path, string_split(path, '/') AS parts FROM p), s AS (SELECT *,
 list_position([regexp_matches(x, '^[0-9]') FOR x IN parts], true) AS k FROM q)
SELECT event_id, regexp_replace(translate(array_to_string(list_slice(parts, k, len(parts)), ''), ':/.-', '____'), '^_+', '') AS label FROM s""")
def source_label(spark, sf_dir):
    rows = L.events(spark, sf_dir, L.PATH_TEXT)
    return rows.select("event_id", C.source_label("line").alias("label"))
