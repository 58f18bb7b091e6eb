import pytest
from pyspark.sql import functions as F

from loomspan.operators import crawl
from loomspan.sources import readers, writers
from loomspan.sources.snapshots import Conflict, Snapshots
from loomspan.streaming import streams


def ids(frame):
    return sorted(r.id for r in frame.collect())


@pytest.fixture
def rows(spark):
    return lambda *xs: spark.createDataFrame([(x,) for x in xs], "id int")


def failing(frame):
    return frame.withColumn("id", F.raise_error(F.lit("lost")).cast("int"))


def test_versions_and_failures(spark, rows, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.version() == 0 and ids(store.read("t", "id int")) == []
    assert store.write(t=rows(1, 2)) == 1 and store.write(more=True, t=rows(3)) == 2
    assert ids(store.read("t", "id int")) == [1, 2, 3] and ids(store.read("t", "id int", version=1)) == [1, 2]
    with pytest.raises(Exception, match="lost"):  # the second table fails after the first is written
        store.write(t=rows(9), u=failing(rows(1)))
    assert store.version() == 2 and ids(store.read("t", "id int")) == [1, 2, 3]
    store.write(t=rows(7))
    assert ids(store.read("t", "id int")) == [7]
    store.expire(keep=1)
    assert ids(store.read("t", "id int")) == [7] and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v")]) == 1
    store.reset(t=rows(1))
    assert ids(store.read("t", "id int")) == []


def test_two_writers_and_torn_commits(spark, rows, tmp_path):
    a, b = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    began = b.version()
    a.write(t=rows(1))
    with pytest.raises(Conflict):
        b.write(t=rows(2), after=began)
    assert ids(b.read("t", "id int")) == [1]
    (tmp_path / "s" / "_commits" / "0000000002").write_text("")  # created, and then its writer died
    assert a.version() == 1 and a.write(t=rows(5)) == 3 and ids(a.read("t", "id int")) == [5]


def test_collection_survives_a_failed_upsert(spark, tmp_path):
    path = str(tmp_path / "c")
    row = lambda *r: spark.createDataFrame(list(r), "text string, meta int, pos int")
    schema = writers.upsert_collection(row(("x", 1, 0)), path).schema
    with pytest.raises(Exception, match="lost"):
        writers.upsert_collection(row(("y", 2, 0)).withColumn("meta", F.raise_error(F.lit("lost")).cast("int")), path)
    assert [(r.text, r.meta) for r in readers.collection(spark, path, schema).collect()] == [("x", 1)]
    writers.reset_collection(readers.collection(spark, path, schema), path)
    assert readers.collection(spark, path, schema).count() == 0


def test_graph_changes_as_one(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = {"A": spark.createDataFrame([("a",)], "key string")}
    edges = spark.createDataFrame([("a", "R", "a")], "src string, rel string, dst string")
    writers.write_graph(nodes, edges, path)
    with pytest.raises(Exception, match="lost"):
        writers.write_graph({"A": nodes["A"].unionByName(nodes["A"])}, edges.withColumn("dst", F.raise_error(F.lit("lost"))), path)
    assert readers.graph(spark, path, "A").count() == 1 and readers.graph(spark, path).count() == 1
    writers.reset_graph(nodes, edges, path)
    assert readers.graph(spark, path, "A").count() == 0 and readers.graph(spark, path).count() == 0


def test_scores_are_written_back(spark, tmp_path):
    path = str(tmp_path / "e")
    ragas = "struct<faithfulness:double,answer_relevancy:double,context_recall:double,context_precision:double>"
    stored = spark.createDataFrame([("1", "q", (0.1, 0.2, 0.3, 0.4)), ("2", "r", None)], f"id string, question string, ragas {ragas}")
    Snapshots(spark, path).write(results=stored)
    scores = spark.createDataFrame([("1", 0.9, 0.8)], "id string, faithfulness double, correctness double")
    assert writers.write_back_scores(scores, path) == 2
    got = {r.id: r.ragas for r in Snapshots(spark, path).read("results", stored.schema).collect()}
    assert tuple(got["1"]) == (0.9, 0.8, 0.3, 0.4) and got["2"] is None


LINKS = [("https://h/a", "https://h/b"), ("https://h/b", "https://h/c"), ("https://h/c", "https://h/d"), ("https://h/d", "https://h/e"), ("https://h/a", "https://x/"), ("https://h/c", "https://h/a")]


def reached(frame):
    return sorted((r.url[-1], r.level, r.parent and r.parent[-1]) for r in frame.collect())


def test_crawl_stops_resumes_and_resets(spark, tmp_path):
    links = spark.createDataFrame(LINKS, "url string, link string")
    seeds = spark.createDataFrame([("https://h/a",), ("https://h/a",), (None,)], "url string")
    whole = reached(crawl.crawl(links, seeds, ["https://h/"]))
    state = Snapshots(spark, str(tmp_path / "state"))
    assert reached(crawl.crawl(links, seeds, ["https://h/"], state=state, until=2)) == whole[:3]
    assert reached(crawl.crawl(links, seeds, ["https://h/"], state=state)) == whole and len(whole) == 5
    crawl.reset_crawl(state)
    assert reached(crawl.crawl(links, seeds, ["https://h/"], state=state, most_pages=2)) == whole[:2]
    for part in (tmp_path / "state").glob("v*/reached/part-*"):
        part.write_bytes(b"broken")
    for part in (tmp_path / "state").glob("v*/reached/.part-*.crc"):
        part.unlink()
    assert state.load("reached", "url string, level int, parent string").count() == 0


def test_crawl_is_as_deep_as_its_links(spark):
    names = [f"https://h/{i:03d}" for i in range(12)]
    links = spark.createDataFrame(list(zip(names, names[1:])), "url string, link string")
    got = crawl.crawl(links, spark.createDataFrame([(names[0],), (names[5],)], "url string"), ["https://h/"], most_pages=1)
    assert [r.url for r in got.collect()] == [names[0]]


def test_contents_are_new_once(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "state"))
    found = lambda *r: spark.createDataFrame(list(r), "url string, sha256 string")
    assert sorted(r.url for r in crawl.new_contents(state, found(("b", "1"), ("a", "1"), ("c", "2"), ("d", None))).collect()) == ["a", "c"]
    assert [r.url for r in crawl.new_contents(state, found(("e", "2"), ("f", "3"))).collect()] == ["f"]


def test_file_names_that_clash(spark):
    files = spark.createDataFrame([("u1", "a.pdf", "1" * 64, 0), ("u2", "a.pdf", "2" * 64, 1), ("u3", "b.pdf", "3" * 64, 2)], "url string, name string, sha256 string, pos int")
    assert {r.url: r.name for r in crawl.without_clashes(files).collect()} == {"u1": "a.pdf", "u2": "a_22222222.pdf", "u3": "b.pdf"}


def test_folder_is_converted_once_also_after_a_kill(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    put = lambda name, content: (folder / name).write_bytes(content)
    put("a.pdf", b"one")
    put("b.pdf", b"two")
    put("c.pdf", b"one")  # the same content again
    convert = lambda files: files.select("name", "sha256", F.upper(F.decode("content", "UTF-8")).alias("text"), F.lit(None).cast("string").alias("error"))
    read = lambda: sorted((r.name, r.text) for r in spark.read.parquet(f"{out}/output").collect())
    streams.convert_folder(spark, str(folder), out, convert)
    assert read() == [("a.pdf", "ONE"), ("b.pdf", "TWO")]
    put("d.pdf", b"three")
    put("e.pdf", b"two")
    broken = lambda files: convert(files).withColumn("text", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):
        streams.convert_folder(spark, str(folder), out, broken)
    streams.convert_folder(spark, str(folder), out, convert)
    streams.convert_folder(spark, str(folder), out, convert)
    assert read() == [("a.pdf", "ONE"), ("b.pdf", "TWO"), ("d.pdf", "THREE")]
    assert Snapshots(spark, f"{out}/manifest").read("files", "name string, sha256 string, error string, batch long").count() == 3


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    convert = lambda files: files.select("name", "sha256", F.when(F.col("name") == "bad", "failed").alias("error"))
    batch = spark.createDataFrame([("a", "1", b"x"), ("bad", "2", b"y")], "name string, sha256 string, content binary")
    write = streams.convert_new(out, convert)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(f"{out}/output").count() == 2
    write(batch, 1)  # what failed is tried again
    assert [r.name for r in spark.read.parquet(f"{out}/output").filter("batch = 1").collect()] == ["bad"]
