import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspan.operators import logs

AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, AT + dt.timedelta(minutes=i // 2), ["academica", "saludo"][i % 2], i % 3 != 0, i if i % 2 else None, [None, 0, 1][i % 3]) for i in range(1, 12)]
    return spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, intent string, is_safe boolean, tokens_used long, feedback int")


@pytest.mark.parametrize(("feedback", "want"), [("1", [2, 5, 8, 11]), ("0", [1, 4, 7, 10]), ("none", [3, 6, 9]), ("other", list(range(1, 12))), (None, list(range(1, 12)))])
def test_three_state_filter(log, feedback, want):
    assert sorted(r.id for r in log.filter(logs.log_filter(feedback=feedback)).collect()) == want


def test_pages(log):
    assert [r.id for r in logs.log_page(log, 1, 4).collect()] == [11, 10, 9, 8]
    assert [r.id for r in logs.log_page(log, -3, 2).collect()] == [11, 10]
    assert logs.log_page(log, 9, 4).count() == 0
    for n, pages in ((0, 1), (10, 1), (11, 2)):
        assert logs.page_count(log.filter(F.col("id") <= n)).first().total_pages == pages


def test_stats_of_nothing(log):
    r = logs.log_stats(log.limit(0)).first()
    assert (r.total_interactions, r.total_tokens, r.avg_feedback, r.safe_pct) == (0, 0, None, 0.0)


def test_feedback(spark, log):
    updates = spark.createDataFrame([(1, 1, 1), (1, 0, 2), (2, 5, 1), (99, 1, 1)], "id long, score int, seq int")
    updated, rejected = logs.apply_feedback(log, updates)
    assert {r.id: r.feedback for r in updated.collect()}[1] == 0 and updated.count() == 11
    assert sorted((r.id, r.score) for r in rejected.collect()) == [(2, 5), (99, 1)]


def test_config(spark):
    writes = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", None, 3), ("b", "", 1)], "key string, value string, seq int")
    defaults = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, value string")
    assert {r.key: r.value for r in logs.effective_config(defaults, logs.latest_config(writes)).collect()} == {"a": "2", "b": "y", "c": "z"}


def test_rows_window_and_sources(spark):
    row = spark.createDataFrame([(1, "q", None)], "id int, question string, answer string")
    assert [(r.kind, r.shown) for r in logs.exploded_rows(row).orderBy("part").collect()] == [("question", "q"), ("answer", "—")]
    window = lambda p, n: spark.range(1).select(logs.page_window(F.lit(p).cast("long"), F.lit(n).cast("long")).alias("w")).first().w
    assert window(1, 1) == [1] and window(5, 10) == [1, 0, 3, 4, 5, 6, 7, 0, 10] and window(3, 5) == [1, 2, 3, 4, 5] and window(4, 6) == [1, 2, 3, 4, 5, 6]
    kinds = spark.createDataFrame([("https://a/b.PDF",), ("https://a",), ("",), (None,)], "u string").select(logs.source_kind(F.col("u")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["pdf", "web", "none", "none"]


def test_over_limit(spark):
    rows = spark.createDataFrame([(1, AT + dt.timedelta(seconds=10 * i)) for i in range(8)], "user_id int, ts timestamp_ntz")
    got = sorted((r.n, r.limited) for r in logs.over_limit(rows, 5).collect())
    assert got == [(2, False), (6, True)]


def test_page_object_of_an_empty_log(spark):
    log = spark.createDataFrame([], "id long, timestamp timestamp, intent string, feedback int, rerank_score double")
    got = logs.page_object(log, 0, 10).first()
    assert (got["items"], got.total, got.page, got.total_pages, got.from_row, got.to_row) == ([], 0, 1, 1, 0, 0)


def test_feedback_percent(spark):
    got = spark.createDataFrame([(0.666,), (0.0,), (None,)], "a double").select(logs.feedback_percent(F.col("a"))).collect()
    assert [r[0] for r in got] == ["67%", "0%", "—"]
