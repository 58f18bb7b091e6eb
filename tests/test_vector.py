import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.vectors import METRICS
from loomspan.operators import vector


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "ip"])
def test_nearest_equals_numpy(spark, metric, monkeypatch):
    r = np.random.default_rng(0)
    x, q = r.normal(size=(300, 8)), r.normal(size=(7, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, query array<double>")
    d = {"cosine": 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1), "l2sq": ((q[:, None] - x) ** 2).sum(2), "ip": 1 - q @ x.T}[metric]
    want = {(i, int(j)) for i in range(7) for j in np.argsort(d[i])[:5]}
    assert {(r.question_id, r.vec_id) for r in vector.nearest(rows, asked, 5, metric).collect()} == want
    monkeypatch.setattr(vector, "BROADCAST_QUESTIONS", 2)  # in blocks
    assert {(r.question_id, r.vec_id) for r in vector.nearest(rows, asked, 5, metric).collect()} == want
    assert vector.nearest(rows.limit(0), asked, 5, metric).count() == 0
    assert vector.nearest(rows.limit(3), asked, 5, metric).count() == 21


def by_columns(rows, asked, k, metric):
    """Search by the column functions over all pairs."""
    pairs = rows.join(asked).select("question_id", "vec_id", METRICS[metric](F.col("embedding"), F.col("query")).alias("distance"))
    return [tuple(map(str, r)) for r in vector.best_of_slices(pairs, ["question_id"], "vec_id", k).orderBy("question_id", "rank").collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "ip"])
def test_nearest_equals_the_column_functions(spark, metric, monkeypatch):
    """Ties of copies, nulls, zeros, other lengths, infinities, and lengths far apart, to the last bit, in one block and in several."""
    r = np.random.default_rng(1)
    x = [v.tolist() for v in np.concatenate([r.normal(size=(120, 8)), np.repeat(r.normal(size=(3, 8)), 15, axis=0), 1e-3 * r.normal(size=(20, 8)), 1e9 * r.normal(size=(3, 8))])]
    odd = [None, [0.0] * 8, [1.0] * 7, [1.0] * 7 + [None], [float("inf")] * 8, [float("nan")] * 8, [], [1e-200] * 8]
    rows = spark.createDataFrame([(7919 * i % 1009, v) for i, v in enumerate(x + odd)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([*x[:5], x[130], x[140], x[170], x[187], *odd])], "question_id long, query array<double>")
    for k in (4, 250):
        for block in (None, 40):
            monkeypatch.setattr(vector, "BROADCAST_QUESTIONS", 10_000 if block is None else 5)
            monkeypatch.setattr(vector, "PRODUCT", 1 << 21 if block is None else 100)
            got = vector.nearest(rows, asked, k, metric, block_rows=block).orderBy("question_id", "rank").collect()
            assert [tuple(map(str, g)) for g in got] == by_columns(rows, asked, k, metric)


def test_nearest_makes_no_row_a_pair(spark):
    """Pairs of vectors are the elements of products of matrices, not rows of a nested loop."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    plan = vector.nearest(rows, rows.selectExpr("vec_id AS question_id", "embedding AS query"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upsert_first_in_a_call_last_over_calls(spark):
    rows = spark.createDataFrame([("x", 1, 0, 0), ("x", 2, 0, 1), ("x", 3, 1, 0), ("x", 4, 1, 5), ("y", 5, 0, 2)], "text string, meta int, call int, pos int")
    got = {r.text: r.meta for r in vector.upsert(rows).collect()}
    assert got == {"x": 3, "y": 5}
    again = vector.upsert(rows.unionByName(rows))
    assert {r.text: r.meta for r in again.collect()} == got


def test_threshold_and_first_query(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a", 0.75), (1, 0, 2, "b", 0.7500001), (1, 0, 3, "c", None), (1, 1, 1, "a", 0.1), (1, 1, 2, "d", 0.2)], "question_id int, query_idx int, rank int, content_id string, distance double")
    got = [(r.content_id, r.distance, r.position) for r in vector.merge_queries(hits).orderBy("position").collect()]
    assert got == [("a", 0.75, 1), ("d", 0.2, 2)]


def test_top_then_cut_and_fallback(spark):
    rows = [(1, s, 0.1 * i, i) for i, s in enumerate([-2.0, 3.0, -5.0, 1.0, -2.1, -9.0])] + [(2, None, 0.5, 1), (2, 4.0, 0.9, 2), (2, 1.0, 0.2, 3)]
    found = vector.top_scored(spark.createDataFrame(rows, "question_id int, score double, distance double, position int"))
    got = [(r.question_id, r.rerank_score) for r in found.orderBy("question_id", "rank").collect()]
    assert got == [(1, 3.0), (1, 1.0), (1, -2.0), (2, 0.0), (2, 0.0), (2, 0.0)]
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    assert {r.question_id: r.best for r in vector.best_score(found, questions).collect()} == {1: 3.0, 2: 0.0, 3: 0.0}
    assert [r.distance for r in found.filter("question_id = 2").orderBy("rank").collect()] == [0.2, 0.5, 0.9]


def test_content_id(spark):
    import hashlib

    assert spark.range(1).select(vector.content_id(F.lit("ñ")).alias("i")).first().i == hashlib.sha256("ñ".encode()).hexdigest()
