import pyarrow as pa
from pyspark.sql import functions as F

from loomspan import session
from loomspan.operators import isolation, text


def test_a_failing_row_leaves_the_others(spark):
    def half(n):
        if n is None:
            raise ValueError("nothing: at all")
        if int(n) % 2:
            raise KeyError(int(n))
        return int(n) // 2

    rows = spark.createDataFrame([(i, i if i < 6 else None) for i in range(8)], "k int, n int")
    results = rows.select("k", isolation.isolated(half, "int")(F.col("n").cast("string")).alias("r")).select("k", "r.*")
    good = isolation.good_rows(results)
    assert good.columns == ["k", "value"] and sorted((r.k, r.value) for r in good.collect()) == [(0, 0), (2, 1), (4, 2)]
    dead = {r.k: (r.error_class, r.message) for r in isolation.dead_letters(results, "k").collect()}
    assert dead == {1: ("KeyError", "1"), 3: ("KeyError", "3"), 5: ("KeyError", "5"), 6: ("ValueError", "nothing: at all"), 7: ("ValueError", "nothing: at all")}
    assert {r.error_class: r.n for r in isolation.failure_counts(results).collect()} == {None: 3, "KeyError": 3, "ValueError": 2}


def test_a_failing_page_leaves_the_others(spark):
    def strict(html):
        if "bad" in html:
            raise ValueError("bad page")
        return text.parsed(html)

    pages = spark.createDataFrame([(1, "u1", "<body><p>x</p></body>"), (2, "u2", "bad"), (3, "u3", None)], "page_id int, url string, html string")
    got = {r.page_id: (r.markdown, r.error) for r in text.page_results(pages, isolation.isolated(strict, text.PARSED)).collect()}
    assert got[1] == ("# u1\n\nx", None) and got[2] == (None, "ValueError: bad page") and got[3][1].startswith("TypeError")
    assert {r.page_id for r in text.page_markdown(pages).collect()} == {1, 2, 3}


def test_batches_are_of_few_rows(spark, monkeypatch):
    """However many rows a partition has, a worker gets at most ``BATCH_ROWS`` together; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    pages = spark.range(2500, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("<p>a</p>").alias("html"), F.lit("http://a/").alias("url"))
    seen = []
    try:
        for most in (session.BATCH_ROWS, 7):
            monkeypatch.setattr(session, "BATCH_ROWS", most)
            text.page_title(F.col("html"), F.col("url"))
            sizes = pages.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
            seen.append(max(r.n for r in sizes.collect()))
        monkeypatch.setattr(session, "BATCH_ROWS", 1000)
        text.page_markdown(pages)
        seen.append(int(spark.conf.get(key)))
    finally:
        spark.conf.set(key, before)
    assert seen == [1000, 7, 7]
