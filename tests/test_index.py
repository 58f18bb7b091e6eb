import numpy as np
import pytest

from loomspan.operators import index, vector


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(1200)]
    return spark.createDataFrame(rows + [(1200, None), (1201, rows[5][1])], "vec_id long, embedding array<double>")


def questions(vectors):
    return vectors.filter("vec_id % 100 = 0 AND vec_id < 1200").selectExpr("vec_id AS question_id", "embedding AS query")


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "ip"])
def test_all_probes_are_exact(vectors, metric):
    centroids = vectors.filter("vec_id % 50 = 0 AND vec_id < 1200").selectExpr("vec_id AS cell", "embedding AS centroid")
    inverted = index.indexed(vectors, centroids, metric=metric)
    assert inverted.count() == 1201  # all but the null vector
    rows = lambda found: sorted((r.question_id, r["rank"], r.vec_id) for r in found.collect())
    exact = vector.nearest(vectors.filter("embedding IS NOT NULL"), questions(vectors), metric=metric)
    assert rows(index.nearest_in(inverted, centroids, questions(vectors), 24, metric=metric)) == rows(exact)


def test_recall_with_fitted_cells_and_pruned_folders(spark, vectors, tmp_path):
    centroids = index.fitted_centroids(vectors, 12)
    path = str(tmp_path / "index")
    index.write_index(index.indexed(vectors, centroids), path, files_a_cell=2)
    stored = index.read_index(spark, path)
    found = index.nearest_in(stored, centroids, questions(vectors), probes=2)
    assert index.recall(found, vector.nearest(vectors.filter("embedding IS NOT NULL"), questions(vectors))) >= 0.9
    one = index.nearest_in(stored, centroids, questions(vectors).limit(1), probes=1)
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and "cell" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_cells_of_ties_and_nulls(spark):
    centroids = spark.createDataFrame([(7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])], "cell long, centroid array<double>")
    rows = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cells for r in index.with_cells(rows, centroids, n=2).collect()}
    assert got == {0: [3, 7], 1: None, 2: [3, 5]}
    with pytest.raises(ValueError):
        index.with_cells(rows, centroids.limit(0))
    assert index.nearest_in(index.indexed(rows.limit(0), centroids), centroids, rows.selectExpr("vec_id AS question_id", "embedding AS query").limit(0), 2).count() == 0


def test_recall_over_the_tables_is_high(spark):
    from loomspan.plans.queries import QUERIES

    for scale in ("sf0.01", "sf0.1"):
        found, exact = (QUERIES[q](spark, f"/root/testdata/{scale}") for q in ("knn_inverted_file", "knn_cosine"))
        assert index.recall(found, exact) >= 0.9

