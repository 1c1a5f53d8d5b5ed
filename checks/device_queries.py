"""Pages, links, device records, archives, the document index."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.functions.columns import member_name
from logweir.operators import dedup as dd, devices as dv, links as lk
from logweir.session import fresh_folder
from logweir.sinks.keyed import KeyedTable
from logweir.plans import jobs
from logweir.sources.archive_members import read_members
from logweir.sources.archives import unpack_records
from logweir.sources.files import read_table

from . import lines as L
from .archives import pack_records, write_archives
from .registry import query

PATTERN = "/[A-Za-z]"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR = """(?is)<a[\\s/]((?:"[^"]*"|''[^'']*''|[^''">])*)>"""
ATTRIBUTE = """(?is)[^\\s=>"''/]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+)"""
HREF = """(?is)^href\\s*=\\s*["'']?(.*?)["'']?$"""
DUCK_LINKS = f"""WITH v AS (SELECT page_id, url, regexp_replace(html, '{HIDDEN}', ' ', 'g') AS html FROM pages),
 a AS (SELECT page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS attrs,
  unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS pos FROM v),
 h AS (SELECT page_id, pos, [regexp_extract(x, '{HREF}', 1) FOR x IN regexp_extract_all(attrs, '{ATTRIBUTE}')
  IF regexp_matches(x, '(?i)^href\\s*=')] AS hrefs FROM a),
 g AS (SELECT page_id, pos, [x FOR x IN hrefs IF x <> ''][1] AS raw FROM h),
 k AS (SELECT page_id, cast(pos AS INT) AS pos, replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&#39;', ''''),
  '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS link FROM g),
 l AS (SELECT * FROM k WHERE regexp_matches(link, '{PATTERN}'))"""


@query("page_links", f"{DUCK_LINKS} SELECT page_id, pos, link, md5(link) AS link_key FROM l")
def page_links(spark, sf_dir):
    return lk.page_links(read_table(spark, sf_dir, "pages"), pattern=PATTERN, keep=["page_id"])


@query("first_seen_urls", f"{DUCK_LINKS} SELECT md5(link) AS link_key, link, min(page_id) AS page_id FROM l GROUP BY link")
def first_seen_urls(spark, sf_dir):
    links = lk.page_links(read_table(spark, sf_dir, "pages"), pattern=PATTERN, keep=["page_id"])
    return lk.first_seen_links(links, ["page_id"])


# pages of the plain protocol were read by an earlier run
@query("new_urls", f"""{DUCK_LINKS}, s AS (SELECT l.*, url LIKE 'http:%' AS old FROM l JOIN pages USING (page_id))
SELECT md5(link) AS link_key, link, min(page_id) AS page_id FROM s WHERE NOT old
 AND link NOT IN (SELECT link FROM s WHERE old) GROUP BY link""")
def new_urls(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    old = F.col("url").startswith("http:")
    seen = lk.first_seen_links(lk.page_links(pages.where(old), pattern=PATTERN, keep=["page_id"]), ["page_id"])
    return jobs.device_links(pages.where(~old), seen, ["page_id"], PATTERN)


@query("member_names", """SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')||'.txt' AS member
FROM pages""")
def member_names(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", member_name("url").alias("member"))


# ------------------------------------------------------------------------ devices

INDEXED_AT = 1_700_000_000_000
DUCK_DEVICES = f"""SELECT 'K'||c_custkey AS id, c_name||'|Ltd' AS company, 'Ms '||c_mktsegment AS person,
 cast({INDEXED_AT} AS BIGINT) AS index_date, '01/02/2003' AS device_index_date, '03/04/2004' AS status_date,
 CASE WHEN c_acctbal < 0 THEN 'DENY' ELSE 'SESE' END AS status, 'device '||c_nationkey AS product
FROM customer WHERE c_nationkey <> 3"""


def device_lines(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer")
    return customers.select("c_custkey", F.expr(L.DEVICE_TEXT).alias("line"))


@query("device_project", DUCK_DEVICES)
def device_project(spark, sf_dir):
    return dv.device_documents(dv.split_records(device_lines(spark, sf_dir)), F.lit(INDEXED_AT).cast("bigint"))


@query("device_stats", "SELECT count(*) AS records, count(*) FILTER (c_nationkey = 3) AS bad_records FROM customer")
def device_stats(spark, sf_dir):
    return dv.record_stats(dv.split_records(device_lines(spark, sf_dir)))


@query("device_json", f"""WITH d AS ({DUCK_DEVICES}) SELECT id AS key, '{{"id":"'||id||'","company":"'||company
 ||'","person":"'||person||'","index_date":'||index_date||',"device_index_date":"'||device_index_date
 ||'","status_date":"'||status_date||'","status":"'||status||'","product":"'||product||'"}}' AS value FROM d""")
def device_json(spark, sf_dir):
    docs = dv.device_documents(dv.split_records(device_lines(spark, sf_dir)), F.lit(INDEXED_AT).cast("bigint"))
    return dv.as_json(docs)


# the same records zipped, 200 keys to an archive, and read back
@query("device_archive", DUCK_DEVICES)
def device_archive(spark, sf_dir):
    lines = device_lines(spark, sf_dir)
    name = F.concat(F.lit("/in/devices-"), F.expr("c_custkey div 200").cast("string"), F.lit(".zip"))
    zips = pack_records(lines.withColumn("archive", name), "archive", "c_custkey", "|".join(dv.COLUMNS))
    return dv.device_documents(unpack_records(zips), F.lit(INDEXED_AT).cast("bigint"))


# archives of 500 keys with a member for each nation, written to files and read by ranges
@query("device_members", f"""WITH d AS ({DUCK_DEVICES}) SELECT 'devices-'||(c_custkey // 500)||'.zip' AS archive,
 'nation-'||c_nationkey||'.txt' AS member, row_number() OVER (PARTITION BY c_custkey // 500, c_nationkey ORDER BY c_custkey) AS record_no,
 id, company, product FROM d JOIN customer ON id = 'K'||c_custkey""")
def device_members(spark, sf_dir):
    folder = fresh_folder(spark, "archives")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lines = device_lines(spark, sf_dir).join(customers, "c_custkey").select(
        "c_custkey", "line", F.format_string("devices-%d.zip", F.expr("c_custkey div 500")).alias("archive"),
        F.format_string("nation-%d.txt", "c_nationkey").alias("member"),
    )
    write_archives(lines, folder, "archive", "member", "c_custkey", "|".join(dv.COLUMNS))
    records = read_members(spark, folder, members="nation-*.txt")
    docs = dv.device_documents(records, F.lit(INDEXED_AT).cast("bigint"), keep=["path", "member", "record_no"])
    return docs.select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "member", "record_no", "id", "company", "product")


@query("device_runs", f"""WITH d AS ({DUCK_DEVICES}), n AS (SELECT d.*, c_custkey % 10 AS k FROM d JOIN customer ON id = 'K'||c_custkey)
SELECT id, {INDEXED_AT} + CASE WHEN k >= 4 THEN 1 ELSE 0 END AS index_date, company, k >= 7 AS created_late,
 k >= 4 AND k < 7 AS replaced FROM n""")
def device_runs(spark, sf_dir):
    """The device job over two runs: archives as files, documents, an index. The second
    run's archives hold some of the first one's records again, read at a later time."""
    table = KeyedTable(spark, fresh_folder(spark, "documents"), StructType.fromDDL("key string, value string"), "key")
    digit = F.col("c_custkey") % 10
    lines = device_lines(spark, sf_dir).withColumn("archive", F.format_string("devices-%d.zip", F.expr("c_custkey div 500")))
    lines = lines.withColumn("member", F.regexp_replace("archive", "zip$", "txt"))
    made = []
    for run, part in enumerate([digit < 7, digit >= 4]):
        folder = fresh_folder(spark, "archives")
        write_archives(lines.where(part), folder, "archive", "member", "c_custkey", "|".join(dv.COLUMNS))
        made.append(jobs.index_devices(read_members(spark, folder), table, run, F.lit(INDEXED_AT + run).cast("bigint")))
    late = made[1].select("key", "created")
    return table.current().join(late, "key", "left").select(
        F.col("key").alias("id"), F.get_json_object("value", "$.index_date").cast("bigint").alias("index_date"),
        F.get_json_object("value", "$.company").alias("company"), F.coalesce("created", F.lit(False)).alias("created_late"),
        F.coalesce(~F.col("created"), F.lit(False)).alias("replaced"),
    )


@query("doc_index", f"""WITH d AS ({DUCK_DEVICES}), n AS (SELECT d.*, c_nationkey FROM d JOIN customer ON id = 'K'||c_custkey)
SELECT id, CASE WHEN c_nationkey >= 10 THEN 'REVISED' ELSE status END AS status,
 c_nationkey BETWEEN 10 AND 14 AS replaced FROM n""")
def doc_index(spark, sf_dir):
    """Two runs over overlapping nations; the second replaces what it sees again."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    records = dv.split_records(device_lines(spark, sf_dir).join(customers, "c_custkey"))
    docs = dv.device_documents(records, F.lit(INDEXED_AT).cast("bigint"), keep=["c_nationkey"])
    first = docs.where("c_nationkey < 15")
    second = docs.where("c_nationkey >= 10").withColumn("status", F.lit("REVISED"))
    bodies = [dv.as_json(d) for d in (first, second)]
    table = KeyedTable(spark, fresh_folder(spark, "documents"), bodies[0].schema, "key")
    for run, body in enumerate(bodies):
        table.upsert(body, run)
    created = table.with_created(bodies[1], before=1)
    state = table.current().join(created.select("key", "created"), "key", "left")
    return state.select(
        F.col("key").alias("id"), F.get_json_object("value", "$.status").alias("status"),
        F.coalesce(~F.col("created"), F.lit(False)).alias("replaced"),
    )
