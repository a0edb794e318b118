"""Raw pages as a data source: batch, stream, restarts, retries."""

import hashlib
import os

import pyarrow as pa
import pyarrow.parquet as pq

from corploom.sources import pages


def put(folder, name, age, titles, group=2):
    table = pa.table({"url": titles, "html": [None if t is None else "" if t == "empty" else f"page of {t}" for t in titles]}, schema=pa.schema([("url", pa.string()), ("html", pa.string())]))
    pq.write_table(table, folder / name, row_group_size=group)
    os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))


def connect():
    calls = {"n": 0}

    def get(title):
        calls["n"] += 1
        if title == "broken" or (title == "shaky" and not os.environ.setdefault("SHAKY", "")):
            os.environ["SHAKY"] = "once"
            raise OSError(title)
        return f"text of {title}"

    return get


def test_ranges(tmp_path):
    put(tmp_path, "b.parquet", 0, ["a", "b", "c"])
    put(tmp_path, "a.parquet", 5, ["d"])
    got = pages.title_ranges(str(tmp_path), "url")
    assert [(os.path.basename(r.path), r.group, r.first, r.last) for r in got] == [("b.parquet", 0, "a", "b"), ("b.parquet", 1, "c", "c"), ("a.parquet", 0, "d", "d")]


def test_batch(spark, tmp_path):
    put(tmp_path, "a.parquet", 0, ["x", "é", None, "empty", "x"])
    pages.register(spark)
    df = spark.read.format("raw_pages").options(titles=str(tmp_path), title="url", text="html", source="s").load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted(r["title"] for r in rows) == ["x", "x", "é"]
    assert all(r["id"] == hashlib.sha1(r["title"].encode()).hexdigest() and r["bytes"] == len(r["text"].encode()) and r["source"] == "s" and r["retrieved_at"][-1] == "Z" for r in rows)


def test_client_is_retried(spark, tmp_path):
    put(tmp_path, "a.parquet", 0, ["ok", "broken", "shaky"], 10)
    pages.register(spark)
    df = spark.read.format("raw_pages").options(titles=f"file://{tmp_path}", title="url", client="tests.test_pages_source:connect", attempts="2", backoff="0").load()
    assert sorted(r["text"] for r in df.collect()) == ["text of ok", "text of shaky"]


def test_stream_goes_on_where_it_stood(spark, tmp_path):
    source, out, checkpoint = tmp_path / "titles", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    pages.register(spark)

    def run():
        stream = spark.readStream.format("raw_pages").options(titles=str(source), title="url", text="html", groups_per_batch="1").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["title"] for r in spark.read.parquet(out).collect())

    put(source, "one.parquet", 0, ["a", "b", "c"])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]  # a restart repeats nothing
    put(source, "a-later.parquet", 9, ["d", "a"])
    assert run() == ["a", "a", "b", "c", "d"]
