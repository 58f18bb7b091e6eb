import math

from pyspark.sql import functions as F

from loomspan.operators import evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_overlap_and_lengths(spark):
    assert one(spark, evaluation.keyword_overlap(F.lit("Grado tiene 240 ECTS"), F.lit("el grado con 240 ects"))) == 0.667
    assert one(spark, evaluation.keyword_overlap(F.lit("a b"), F.lit("a b"))) == 0.0
    assert one(spark, evaluation.no_context(F.lit("No TENGO datos"), "no tengo")) and one(spark, evaluation.answer_length(F.lit(" a  b "))) == 2


def test_summary_of_nothing_divides_by_nothing(spark):
    r = evaluation.run_summary(spark.createDataFrame([], "answer string, error string, no_context boolean, overlap double")).first()
    assert r.total == 0 and r.answered_rate is None and r.avg_overlap == 0.0


def test_stats_ignore_nan(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("a", math.nan, 0.7), (None, None, None)], "category string, faithfulness double, correctness double")
    got = {r.category: (r.n, r.n_scored, r.avg_faithfulness, r.avg_correctness) for r in evaluation.score_stats(rows).collect()}
    assert got == {"a": (2, 1, 1.0, 0.6), None: (1, 0, None, None), "__global__": (3, 1, 1.0, 0.6)}


def test_comparison(spark):
    plain = spark.createDataFrame([(1, 0.29), (2, 0.3), (3, 0.1), (4, None)], "id int, correctness double")
    better = spark.createDataFrame([(1, 0.81), (2, 0.9), (3, 0.8), (4, 0.9)], "id int, correctness double")
    assert [r.id for r in evaluation.critical_successes(plain, better).collect()] == [1]
    assert one(spark, evaluation.improvement(F.lit(0.5), F.lit(0.75))) == 50.0 and one(spark, evaluation.improvement(F.lit(0.0), F.lit(1.0))) is None


def test_lists_zip_and_patch(spark):
    items = spark.createDataFrame([("r", 1, "x", 0.1), ("r", 2, "y", 0.9), ("r", 3, "z", None)], "run string, pos int, id string, correctness double")
    assert {(r.id, r.list) for r in evaluation.top_and_bottom(items).collect()} == {("x", "top"), ("y", "top"), ("x", "bottom"), ("y", "bottom")}
    scores = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.4)], "run string, pos int, s double")
    assert {r.id: r.s for r in evaluation.zip_scores(items, scores).collect()} == {"x": 0.3, "y": 0.4, "z": None}
    twice = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id int, v string, pos int")
    assert evaluation.last_by_id(twice).first().v == "b"
    kind = "id int, ragas struct<faithfulness:double,answer_relevancy:double,context_recall:double,context_precision:double>"
    results = spark.createDataFrame([(1, (None, None, 0.5, 0.6)), (2, (0.1, 0.2, 0.3, 0.4))], kind)
    new = spark.createDataFrame([(1, 0.7, 0.8)], "id int, faithfulness double, correctness double")
    assert {r.id: tuple(r.ragas) for r in evaluation.patch_scores(results, new).collect()} == {1: (0.7, 0.8, 0.5, 0.6), 2: (0.1, 0.2, 0.3, 0.4)}
    assert {r.id: tuple(r.ragas) for r in evaluation.patch_scores(results, new, True).collect()}[1] == (0.7, 0.8, None, None)


def test_repeated_ids_count_once_in_critical_successes(spark):
    plain = spark.createDataFrame([(1, 0.9, 0), (1, 0.1, 1)], "id int, correctness double, pos int")
    graph = spark.createDataFrame([(1, 0.1, 0), (1, 0.9, 1)], "id int, correctness double, pos int")
    assert [(r.id, r.improvement) for r in evaluation.critical_successes(plain, graph).collect()] == [(1, 0.8)]


def test_error_classes(spark):
    rows = spark.createDataFrame([(None, None), (404, "x"), (200, None), (None, "odd"), (200, "late")], "status int, message string")
    got = [tuple(r[0]) for r in rows.select(evaluation.error_class(F.col("status"), F.col("message"))).collect()]
    assert got == [("ConnectionError", True), ("HTTP 404", True), (None, True), ("odd", False), ("late", False)]
