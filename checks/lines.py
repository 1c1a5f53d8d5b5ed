"""Log lines made from the given tables, by one expression per engine.

``*_LINE`` is the Spark expression, ``DUCK_*`` the same text in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.session import fresh_folder
from logweir.sources.files import read_table

EVENT_TEXT = """concat('- ', cast(unix_seconds(cast(ts as timestamp)) as string), ' ',
 date_format(ts, 'yyyy.MM.dd'), ' node', cast(user_id % 8 as string), ' ',
 date_format(ts, 'MMM dd HH:mm:ss'), ' ',
 case when event_type = 'error' then 'src@admin' else 'u@n' end, cast(user_id as string), ' ',
 event_type, ': ', case when value > 100 then 'IRQ ' else 'run ' end, props)"""
DUCK_EVENT_TEXT = """'- '||cast(epoch_us(ts)//1000000 as varchar)||' '||strftime(ts,'%Y.%m.%d')||' node'
 ||cast(user_id%8 as varchar)||' '||strftime(ts,'%b %d %H:%M:%S')||' '
 ||case when event_type='error' then 'src@admin' else 'u@n' end||cast(user_id as varchar)||' '
 ||event_type||': '||case when value>100 then 'IRQ ' else 'run ' end||props"""

# lines of three hours of the day carry an alert tag, which no parser accepts
DAMAGED_TEXT = f"case when hour(ts) in (3, 11, 19) then concat('ALERT ', {EVENT_TEXT}) else {EVENT_TEXT} end"
DUCK_DAMAGED_TEXT = (
    f"case when hour(ts) in (3, 11, 19) then 'ALERT '||{DUCK_EVENT_TEXT} else {DUCK_EVENT_TEXT} end"
)

ORDER_TEXT = """concat('- ', cast(unix_seconds(cast(o_orderdate as timestamp)) as string), ' ',
 date_format(o_orderdate, 'yyyy.MM.dd'), ' shop', cast(o_custkey % 8 as string), ' ',
 date_format(o_orderdate, 'MMM dd HH:mm:ss'), ' c@shop', cast(o_custkey % 8 as string), ' order ',
 o_orderstatus, ' ', o_orderpriority, '  customer ', cast(o_custkey as string))"""
DUCK_ORDER_TEXT = """'- '||cast(epoch_us(o_orderdate)//1000000 as varchar)||' '||strftime(o_orderdate,'%Y.%m.%d')
 ||' shop'||cast(o_custkey%8 as varchar)||' '||strftime(o_orderdate,'%b %d %H:%M:%S')||' c@shop'
 ||cast(o_custkey%8 as varchar)||' order '||o_orderstatus||' '||o_orderpriority||'  customer '
 ||cast(o_custkey as varchar)"""

LATENCY_TEXT = """concat('[', date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm:ss'), '.',
 lpad(cast(event_id % 1000 as string), 3, '0'), '] [principal_latencies] [info] 127.0.0.1:31002: traceId: -',
 cast(event_id as string), ', parentId: 7, id: 9, p50: ', cast(user_id * 3 + 100 as string), 'us, p95: 963us, p99: 1094us, p999: ',
 cast(user_id * 11 + 900 as string), 'us')"""
DUCK_LATENCY_TEXT = """'['||strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S')||'.'||lpad(cast(event_id%1000 as varchar),3,'0')
 ||'] [principal_latencies] [info] 127.0.0.1:31002: traceId: -'||cast(event_id as varchar)
 ||', parentId: 7, id: 9, p50: '||cast(user_id*3+100 as varchar)||'us, p95: 963us, p99: 1094us, p999: '
 ||cast(user_id*11+900 as varchar)||'us'"""

THROUGHPUT_TEXT = """concat('[', date_format(date_trunc('day', ts), 'yyyy-MM-dd HH:mm:ss'), '.',
 lpad(cast(event_id % 1000 as string), 3, '0'), '] [incoming_throughput] [info] ', cast(user_id * 17 + 40000 as string),
 ' req in ', cast(1000000 + event_id % 5000 as string), 'us. total: 2068663 req')"""
DUCK_THROUGHPUT_TEXT = """'['||strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S')||'.'||lpad(cast(event_id%1000 as varchar),3,'0')
 ||'] [incoming_throughput] [info] '||cast(user_id*17+40000 as varchar)||' req in '
 ||cast(1000000+event_id%5000 as varchar)||'us. total: 2068663 req'"""

# sizes are whole tenths of a GB, so that no mean lies on a rounding edge
HARDWARE_TEXT = """concat('[', date_format(date_trunc('minute', ts), 'yyyy-MM-dd HH:mm:ss'), '.',
 lpad(cast(event_id % 1000 as string), 3, '0'), '] [hardware_usage_monitor] [info] cpu 1min: ', cast(user_id % 3 as string), '.',
 cast(event_id % 10 as string), ', cpu 5min: 1.', cast(user_id % 10 as string), ', cpu 15min: 0.10, total mem: ',
 cast(28 + user_id % 4 as string), '.4 GB, free mem: ',
 case when event_id % 2 = 0 then concat(cast(20 + user_id % 5 as string), '.5 GB')
 else concat(cast(102 * (1 + user_id % 4) + (4 * (1 + user_id % 4)) div 10 as string), '.', cast(4 * (1 + user_id % 4) % 10 as string), ' MB') end,
 ', shared mem: 0.001 KB, buffer mem: 71.824 MB, total swap: 30.000 GB, free swap: 30.000 GB, # procs: 293')"""
DUCK_HARDWARE_TEXT = """'['||strftime(date_trunc('minute',ts),'%Y-%m-%d %H:%M:%S')||'.'||lpad(cast(event_id%1000 as varchar),3,'0')
 ||'] [hardware_usage_monitor] [info] cpu 1min: '||cast(user_id%3 as varchar)||'.'||cast(event_id%10 as varchar)
 ||', cpu 5min: 1.'||cast(user_id%10 as varchar)||', cpu 15min: 0.10, total mem: '||cast(28+user_id%4 as varchar)
 ||'.4 GB, free mem: '||case when event_id%2=0 then cast(20+user_id%5 as varchar)||'.5 GB'
 else cast(102*(1+user_id%4)+(4*(1+user_id%4))//10 as varchar)||'.'||cast(4*(1+user_id%4)%10 as varchar)||' MB' end
 ||', shared mem: 0.001 KB, buffer mem: 71.824 MB, total swap: 30.000 GB, free swap: 30.000 GB, # procs: 293'"""

PATH_TEXT = """concat('/data/', date_format(ts, 'yyyy-MM-dd'), '/10.0.0.', cast(user_id % 8 as string),
 '/run:', event_type, '/latency.csv')"""
DUCK_PATH_TEXT = """'/data/'||strftime(ts,'%Y-%m-%d')||'/10.0.0.'||cast(user_id%8 as varchar)||'/run:'
 ||event_type||'/latency.csv'"""

DEVICE_TEXT = """concat('K', cast(c_custkey as string), '|"', c_name, '|Ltd"|Ms ', c_mktsegment, '|1 Main St||Town|ST|US|',
 cast(10000 + c_nationkey as string), '||01/02/2003|03/04/2004|',
 case when c_acctbal < 0 then 'DENY' else 'SESE' end, '|GU|KGN|Summary||||N|',
 case when c_nationkey = 3 then 'device' else concat('N|device ', cast(c_nationkey as string)) end)"""


def events(spark: SparkSession, sf_dir: str, text: str = EVENT_TEXT, *more: str) -> DataFrame:
    """event_id, line (and more columns) of the events table."""
    table = read_table(spark, sf_dir, "events")
    return table.select("event_id", F.expr(text).alias("line"), *[F.expr(m) for m in more])


BATCHES = 4


def in_batches(spark: SparkSession, sf_dir: str, name: str, key: str, batches: int = BATCHES) -> DataFrame:
    """A whole table as a stream of several micro-batches, one range of ``key`` after the other.
    Each range has as many files as the session has cores, which are one micro-batch together."""
    table, folder = read_table(spark, sf_dir, name), fresh_folder(spark, f"{name}-in-batches")
    low, high = table.agg(F.min(key), F.max(key)).first()
    step, files = (high - low) // batches + 1, max(1, spark.sparkContext.defaultParallelism)
    nothing = spark.createDataFrame([], table.schema)
    written = 0
    for k in range(batches):  # a file source takes files in the order of their writing
        part = table.where(F.col(key).between(low + k * step, low + (k + 1) * step - 1))
        part.repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
        written += files
        for _ in range(written - _files(spark, folder)):  # a range of few rows leaves files out
            nothing.write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _files(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sum(not s.getPath().getName().startswith(("_", ".")) for s in listed)


def streamed_events(spark: SparkSession, sf_dir: str, text: str = EVENT_TEXT) -> DataFrame:
    return in_batches(spark, sf_dir, "events", "event_id").select("event_id", F.expr(text).alias("line"))


def orders(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    table = read_table(spark, sf_dir, "orders")
    return table.select("o_orderkey", F.expr(ORDER_TEXT).alias("line"), *[F.expr(m) for m in more])


def duck_events(text: str = DUCK_EVENT_TEXT, *more: str) -> str:
    return "SELECT " + ", ".join(["event_id", f"{text} AS line", *more]) + " FROM events"


def duck_orders(*more: str) -> str:
    return "SELECT " + ", ".join(["o_orderkey", f"{DUCK_ORDER_TEXT} AS line", *more]) + " FROM orders"
