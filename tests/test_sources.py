from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from logweir.operators import devices as dv, links as lk
from logweir.plans import jobs
from logweir.session import CHECKPOINT_DIR, drop_written, fresh_folder, shared_folder, written_table
from logweir.sinks.keyed import KeyedTable
from logweir.sinks.writers import write_log
from logweir.sources import messages as ms
from logweir.sources.archives import read_archives, unpack_records
from logweir.streaming.jobs import each_batch
from logweir.sources.files import is_folder, read_lines, read_words, stream_table


# ---------------------------------------------------------------------- archives


def record(*values):
    return "|".join([*values, *[""] * (22 - len(values))])


def zipped(path, text, member=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member or path.name.rsplit(".", 1)[0] + ".txt", text)


def cells(n, **at):
    row = [f"c{i}" for i in range(n)]
    for k, v in at.items():
        row[int(k[1:])] = v
    return "|".join(row)


@pytest.fixture
def archive_folder(tmp_path):
    header = "|".join(dv.COLUMNS)
    good = cells(22, _0="K1", _2='"a|b ""q"""', _21="Ünit")
    split = cells(22, _0="K2", _1='"two\nlines"')
    body = "\n".join([header, good, cells(21, _0="short"), cells(23, _0="long"), split]) + "\n"
    zipped(tmp_path / "first.1.zip", body.encode())
    zipped(tmp_path / "second.zip", (header + "\n" + cells(22, _0="K3", _21="x")).encode() + b"\xff\n")
    zipped(tmp_path / "third.zip", b"x", member="other.txt")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_archives(spark, archive_folder, rows):
    records = unpack_records(read_archives(spark, archive_folder), rows_per_batch=2).cache()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in records.where("error is not null").collect()}
    assert set(errors) == {"third.zip", "broken.zip"} and errors["broken.zip"].startswith("BadZipFile")
    assert dv.record_stats(records.where("error is null")).head() == (5, 2)
    docs = dv.device_documents(records, F.lit(5).cast("bigint"))
    assert rows(docs, "id", "company", "person", "index_date", "product") == [
        ("K1", "c1", 'a|b "q"', 5, "Ünit"), ("K2", "two\nlines", "c2", 5, "c21"), ("K3", "c1", "c2", 5, "x�")]
    messages = {r.key: json.loads(r.value) for r in jobs.device_index(read_archives(spark, archive_folder)).collect()}
    assert set(messages) == {"K1", "K2", "K3"}
    assert list(messages["K1"]) == dv.DOCUMENT and messages["K1"]["device_index_date"] == "c10"
    assert messages["K1"]["index_date"] > 1_600_000_000_000


def test_archives_into_an_index(spark, archive_folder, tmp_path, rows):
    """Runs replace documents; a stream of archives leaves the same table."""
    first = read_archives(spark, archive_folder, "first*.zip")
    schema = jobs.device_index(first).schema
    table = KeyedTable(spark, fresh_folder(spark, "index"), schema, "key")
    when = F.lit(1).cast("bigint")
    assert rows(jobs.index_devices(first, table, 0, when), "key", "created") == [("K1", True), ("K2", True)]
    both = read_archives(spark, archive_folder)
    later = jobs.index_devices(both, table, 1, F.lit(2).cast("bigint"))
    assert rows(later, "key", "created") == [("K1", False), ("K2", False), ("K3", True)]
    date = F.get_json_object("value", "$.index_date")
    assert rows(table.current().select("key", date)) == [("K1", "2"), ("K2", "2"), ("K3", "2")]
    stream = jobs.device_index(read_archives(spark, archive_folder, streaming=True, max_files_per_trigger=2), F.lit(2).cast("bigint"))
    streamed = KeyedTable(spark, fresh_folder(spark, "index"), schema, "key")
    each_batch(stream, streamed.sink(), str(tmp_path / "check")).awaitTermination()
    assert rows(streamed.current()) == rows(table.current())


def test_record_lines(spark):
    texts = [cells(22), cells(21), cells(23), cells(22, _1='"x|y"', _5="", _6='""')]
    out = dv.split_records(spark.createDataFrame([(t,) for t in texts], "line string")).collect()
    assert [r.fields is not None for r in out] == [True, False, False, True]
    assert (out[3].fields[1], out[3].fields[5], out[3].fields[6], out[3].fields[21]) == ("x|y", "", "", "c21")


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(cells(22, _0="K1"),), (cells(21),), (None,)], "line string")
    docs = dv.device_documents(dv.split_records(lines), F.lit(0).cast("bigint"))
    assert [r.key for r in dv.as_json(docs).orderBy("key").collect()] == ["", "K1"]
    plan = dv.as_json(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1  # not again in the filter, for each of its columns


def test_large_archive_is_whole(spark, tmp_path):
    n = 25_000
    body = "\n".join(["|".join(dv.COLUMNS), *[cells(22, _0=f"K{i}") for i in range(n)]])
    zipped(tmp_path / "many.zip", body.encode())
    records = unpack_records(read_archives(spark, str(tmp_path)))
    docs = dv.device_documents(records, F.lit(0).cast("bigint"))
    assert docs.agg(F.count_distinct("id")).head()[0] == n
    assert records.agg(F.max("record_no")).head()[0] == n


# ------------------------------------------------------------------------- links

PAGE = """<html><!-- <a href="hidden.zip">no</a> --><script>var s = '<a href="script.zip">';</script>
<a href="one.zip">1</a><A CLASS='x' HREF='two.zip?a=1&amp;b=2'>2</A><a title="see href=fake.zip" href=three.zip >3</a>
<a href="" href="four.zip">4</a><a data-href="five.zip">5</a><abbr href="six.zip">6</abbr><a name="x">7</a>
<a href="page.html">8</a><a title="a > b" href="seven.zip">9</a><link href="eight.zip"><a
  href = "nine.zip">9</a><a href="x.zip/readme">10</a></html>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id int, html string")
    got = [r.link for r in lk.page_links(pages, keep=["page_id"]).orderBy("page_id", "pos").collect()]
    assert got == ["one.zip", "two.zip?a=1&b=2", "three.zip", "four.zip", "seven.zip", "nine.zip", "x.zip/readme"]
    assert lk.page_links(pages, pattern=r"\.html$").count() == 1


def test_link_on_a_long_page(spark):
    page = "<p>" + "x" * 200_000 + "</p>" + "<a " + "k='v' " * 3000 + "href='far.zip'>" + "<!-- " + "y" * 100_000 + "-->"
    pages = spark.createDataFrame([(page,)], "html string")
    assert [r.link for r in lk.page_links(pages).collect()] == ["far.zip"]


def test_new_links_only(spark, rows):
    pages = spark.createDataFrame(
        [(1, '<a href="a.zip">'), (2, '<a href="b.zip"><a href="a.zip">'), (3, '<a href="b.zip">')], "page_id int, html string")
    first = jobs.device_links(pages.where("page_id = 1"), None, ["page_id"])
    assert rows(first, "link") == [("a.zip",)]
    later = jobs.device_links(pages.where("page_id > 1"), first, ["page_id"])
    assert rows(later, "link", "page_id") == [("b.zip", 2)]


# ---------------------------------------------------------------------- messages


def test_log_options():
    got = ms.log_options(["h1:1", "h2:2"], "a, b,", from_beginning=True, max_per_trigger=7, group_prefix="g")
    assert got == {
        "kafka.bootstrap.servers": "h1:1,h2:2", "subscribe": "a,b", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "7", "groupIdPrefix": "g"}
    assert ms.log_options("h", "a")["startingOffsets"] == "latest"
    assert ms.log_options("h", "a", starting_offsets='{"a":{"0":5}}')["startingOffsets"] == '{"a":{"0":5}}'


def test_messages_kept_as_files(spark, tmp_path, rows):
    lines = spark.createDataFrame([(i, f"line number {i} " + "é" * 10) for i in range(10)], "offset bigint, line string")
    body = lines.select("offset", F.lit("t").alias("topic"), (F.col("offset") % 2).cast("int").alias("partition"),
                        F.current_timestamp().alias("timestamp"), F.encode("line", "UTF-8").alias("value"), "line")
    full = body.select("topic", "partition", "offset", "timestamp", "value", F.lit(b"k").alias("key"))
    full.write.parquet(str(tmp_path / "log"))
    back = ms.read_message_files(spark, str(tmp_path / "log"))
    assert rows(ms.text_lines(back), "line") == rows(lines, "line")
    assert rows(ms.topic_metrics(back)) == [("t", 0, 8, 5 * 34, 5), ("t", 1, 9, 5 * 34, 5)]
    assert rows(ms.sampled_messages(back, 4), "offset") == [(0,), (4,), (8,)]
    keys = [bytes(r.key) for r in ms.fill_messages(lines).collect()]
    assert all(len(k) == 24 for k in keys)


def test_write_log(spark, tmp_path, rows):
    pairs = spark.createDataFrame([(1, "a"), (2, "b")], "key bigint, value string")
    assert write_log(pairs, format="json", path=str(tmp_path / "out")) is None
    assert rows(spark.read.schema("key string, value string").json(str(tmp_path / "out"))) == [("1", "a"), ("2", "b")]
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        write_log(stream, format="json", path=str(tmp_path / "s"))
    write_log(stream, format="json", checkpoint=str(tmp_path / "c"), available_now=True, path=str(tmp_path / "s")).awaitTermination()
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_words(spark, tmp_path, rows):
    draw = random.Random(1)
    words = [draw.choice(["alpha", "beta", "gamma"]) for _ in range(10_007)]
    (tmp_path / "words.data").write_text(",".join(words))
    counts = jobs.word_count(read_words(spark, str(tmp_path / "words.data")))
    assert rows(counts) == sorted(((w, words.count(w)) for w in set(words)), key=repr)


def test_lines_and_tables(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    (tmp_path / "b.log").write_text("z")
    assert read_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).count() == 3
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    assert is_folder(spark, str(tmp_path / "t.parquet")) and not is_folder(spark, str(tmp_path / "a.log"))
    assert stream_table(spark, str(tmp_path), "t", 1).isStreaming


# ---------------------------------------------------------------- shared folder


class FakeSession:
    """A session with a master and settings, as far as the folder needs them."""

    def __init__(self, master, settings, checkpoint_dir=None):
        class Context:
            def getCheckpointDir(self):
                return checkpoint_dir

        self.conf, self.sparkContext = settings, Context()
        self.sparkContext.master = master


def test_shared_folder_is_the_one_named():
    named = FakeSession("spark://host:7077", {CHECKPOINT_DIR: "hdfs://nn/check/"}, "hdfs://nn/check/1234")
    assert shared_folder(named) == "hdfs://nn/check"
    assert shared_folder(FakeSession("yarn", {}, "hdfs://nn/other")) == "hdfs://nn/other"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_folder(FakeSession("spark://host:7077", {}))


def test_written_table_lies_in_the_shared_folder(spark):
    table = written_table(spark.range(5).select("id", F.lit(None).cast("string").alias("s")), "x")
    assert table.count() == 5 and table.columns == ["id", "s"]
    assert all(f.split("file:", 1)[-1].lstrip("/").startswith(shared_folder(spark).lstrip("/")) for f in table.inputFiles())
    assert drop_written(spark) >= 1 and drop_written(spark) == 0
    assert not is_folder_there(table)


def is_folder_there(table):
    import os

    return any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles())
