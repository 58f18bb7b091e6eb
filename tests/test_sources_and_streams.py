import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from loomspan.operators import crawl
from loomspan.sources import readers, writers
from loomspan.streaming import streams

AT = dt.datetime(2024, 1, 1)


def test_files_and_maps(spark, tmp_path):
    (tmp_path / "b.md").write_text("B\nb")
    (tmp_path / "a.md").write_text("A")
    (tmp_path / ".hidden.md").write_text("h")
    (tmp_path / "x.txt").write_text("x")
    assert [(r.name, r.text) for r in readers.markdown_files(spark, str(tmp_path)).collect()] == [("a.md", "A"), ("b.md", "B\nb")]
    (tmp_path / "pdf.json").write_text(json.dumps({"a.pdf": {"source_url": "u1"}, "b.md": {"source_url": "u2"}, "c": "ignored"}))
    (tmp_path / "web.json").write_text(json.dumps({"b.md": "u3", "d": {"x": 1}}))
    maps = readers.url_maps(spark, str(tmp_path / "pdf.json"), str(tmp_path / "web.json"))
    assert {r.name: r.url for r in maps.collect()} == {"a.pdf": "u1", "b.md": "u3"}
    files = spark.createDataFrame([("a.md",), ("b.md",), ("z.md",)], "name string")
    assert {r.name: r.source_url for r in readers.with_url(files, maps).collect()} == {"a.md": "u1", "b.md": "u3", "z.md": ""}
    assert readers.url_maps(spark, None, None).count() == 0
    assert readers.binary_files(spark, str(tmp_path), "*.txt").first().name == "x.txt"


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps([{"question": "q"}, {"id": "7", "category": "c", "question": "r"}]))
    items = readers.eval_items(spark, str(tmp_path / "set.json"))
    assert [(r.id, r.category) for r in items.orderBy("pos").collect()] == [("1", "unknown"), ("7", "c")]
    assert readers.selected(items, "c", 1).first().id == "7"
    listed = [{"id": "1", "answer": "a", "metrics": {"keyword_overlap": 0.5}}]
    for name, content in (("list.json", listed), ("object.json", {"meta": {}, "results": listed})):
        (tmp_path / name).write_text(json.dumps(content))
        assert readers.eval_results(spark, str(tmp_path / name)).first().metrics.keyword_overlap == 0.5


def test_collections_and_logs(spark, tmp_path):
    path = str(tmp_path / "c")
    row = lambda *r: spark.createDataFrame(list(r), "text string, meta int, pos int")
    writers.upsert_collection(row(("x", 1, 0), ("x", 2, 1)), path)
    schema = writers.upsert_collection(row(("x", 3, 0), ("y", 4, 1)), path).schema
    stored = lambda: readers.collection(spark, path, schema)
    assert {r.text: r.meta for r in stored().collect()} == {"x": 3, "y": 4}
    assert writers.upsert_collection(row(("z", 9, 0)), path, dry_run=True).count() == 1 and stored().count() == 2
    writers.reset_collection(stored(), path)
    assert stored().count() == 0
    log = spark.createDataFrame([(AT + dt.timedelta(seconds=i), f"q{i}") for i in range(20, 0, -1)], "timestamp timestamp_ntz, question string")
    out = writers.append_log(log, str(tmp_path / "log"), last_id=5)
    assert [r.question for r in out.orderBy("id").collect()] == [f"q{i}" for i in range(1, 21)] and sorted(r.id for r in out.collect()) == list(range(6, 26))
    assert "rerank_score" in readers.log_rows(spark, str(tmp_path / "log")).columns
    writers.write_report(out.limit(1), str(tmp_path / "r"))
    texts = spark.createDataFrame([("n.md", "t")], "name string, text string")
    assert tuple(writers.write_texts(texts, str(tmp_path / "t"), dry_run=True).first()) == (1, 1) and not (tmp_path / "t").exists()
    writers.write_texts(texts, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1 and spark.read.text(str(tmp_path / "t")).first().value == "t"


def test_crawl(spark):
    links = [("https://h/a", "https://h/b"), ("https://h/a", "https://h/c"), ("https://h/b", "https://h/a"), ("https://h/b", "https://h/d"), ("https://h/c", "https://h/d"), ("https://h/d", "https://x/e"), ("https://h/d", "https://h/pic.png")]
    table = spark.createDataFrame(links, "url string, link string")
    seeds = spark.createDataFrame([("https://h/a",)], "url string")
    got = {r.url: (r.level, r.parent) for r in crawl.crawl(table, seeds, ["https://h/"]).collect()}
    assert got == {"https://h/a": (0, None), "https://h/b": (1, "https://h/a"), "https://h/c": (1, "https://h/a"), "https://h/d": (2, "https://h/b")}
    assert crawl.crawl(table, seeds, ["https://h/"], most_pages=2).count() == 2
    kinds = spark.createDataFrame([("https://h/a.pdf", "x"), ("https://h/a", "application/PDF"), ("https://h/a", "text/html; x"), ("https://h/a", None)], "u string, t string")
    assert [r.k for r in kinds.select(crawl.dispatch(F.col("u"), F.col("t")).alias("k")).collect()] == ["pdf", "pdf", "page", "skip"]
    seen = spark.createDataFrame([("page", None, "a"), ("page", "timeout", None), ("pdf", None, "h"), ("pdf", None, "h")], "kind string, error string, content string")
    assert tuple(crawl.counters(seen).first()) == (1, 1, 1, 1)


def test_changed_files(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    known = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "name string, sha256 string")
    outputs = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(r.name for r in crawl.changed_files(files, known, outputs).collect()) == ["b", "c"]
    assert crawl.changed_files(files, known, outputs, force=True).count() == 3


def drain(frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_stream_limits_and_contents(spark, tmp_path):
    rows = spark.createDataFrame([(1, AT + dt.timedelta(seconds=i), f"h{i % 3}") for i in range(8)], "user_id int, ts timestamp_ntz, sha256 string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert [(r.n, r.limited) for r in drain(streams.rate_limited(stream, 5), "update", "limits")] == [(8, True)]
    assert sorted(r.sha256 for r in drain(streams.new_contents(stream), "append", "contents")) == ["h0", "h1", "h2"]


def test_stream_updates_and_memory(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, seq int, v string")
    rows.write.parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "u"))
    stream.writeStream.foreachBatch(streams.apply_updates(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.id: r.v for r in streams.latest(spark.read.parquet(str(tmp_path / "out"))).collect()} == {1: "b", 2: "c"}
    turns = spark.createDataFrame(pd.DataFrame({"conv_id": [1] * 8, "turn": range(8), "text": [f"t{i}" for i in range(8)]}))
    turns.coalesce(1).write.parquet(str(tmp_path / "t"))
    talk = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t"))
    assert [r.memory for r in drain(streams.with_memory(talk), "update", "memory_of")] == [["t2", "t3", "t4", "t5", "t6", "t7"]]
