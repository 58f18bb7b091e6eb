"""Approximate vector search by an inverted file: cells around centroids, of which a question reads only the nearest.

Assigning a row to its cell is a product of matrices in an Arrow function, so no pair of
row and centroid is ever a row. What a search finds is re-ranked by exact distances; what it
misses lies in cells that weren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.vectors import METRICS
from loomspan.operators.vector import BROADCAST_QUESTIONS, best_of_slices

#: Cells of an index at most, so that every task can hold their centroids.
MOST_CELLS = 65_536
#: Rows that ``fitted_centroids`` looks at, at most: those of least hash of their key.
FITTED_ROWS = 100_000
#: Rows of a batch whose distances to all centroids are held together.
TOGETHER = 512


def fitted_centroids(collection: DataFrame, cells: int, key: str = "vec_id", vector: str = "embedding", rounds: int = 10, seed: int = 7) -> DataFrame:
    """Centroids (cell, centroid) by k-means over at most ``FITTED_ROWS`` rows; the index is of all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = collection.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(FITTED_ROWS)
    points = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, maxIter=rounds, seed=seed).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return collection.sparkSession.createDataFrame(rows, "cell long, centroid array<double>")


def _held(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(centroids.select("cell", "centroid").limit(MOST_CELLS + 1).collect())
    if not 0 < len(rows) <= MOST_CELLS:
        raise ValueError(f"an index has 1 to {MOST_CELLS} cells")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def with_cells(rows: DataFrame, centroids: DataFrame, vector: str = "embedding", n: int = 1, name: str = "cells", metric: str = "cosine") -> DataFrame:
    """Rows with the ``n`` nearest cells of their vector in an array, nearest first, ties by cell; null for a null vector.

    Nearness is by ``metric``: cosine distance, squared distance ("l2sq") or inner product ("ip").
    """
    cells, points = _held(centroids)
    if metric == "cosine":
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    lengths = (points**2).sum(axis=1) if metric == "l2sq" else 0.0
    most = min(n, len(cells))
    held = rows.sparkSession.sparkContext.broadcast((cells, points, lengths))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, points, lengths = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                column = batch.column(vector)
                known = np.asarray(column.is_valid())
                flat = np.asarray(column.drop_null().flatten(), np.float64).reshape(int(known.sum()), points.shape[1])
                nearest: list = [None] * batch.num_rows
                if flat.size:
                    far = np.round(lengths - (2.0 if metric == "l2sq" else 1.0) * (flat @ points.T), 12)
                    for i, row in zip(np.flatnonzero(known), cells[np.argsort(far, axis=1, kind="stable")[:, :most]], strict=True):
                        nearest[i] = row.tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.list_(pa.int64()))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def indexed(collection: DataFrame, centroids: DataFrame, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The inverted file: key, vector and cell of every row that has a vector."""
    placed = with_cells(collection.select(key, vector).filter(F.col(vector).isNotNull()), centroids, vector, 1, "_cells", metric)
    return placed.select(key, vector, F.get("_cells", F.lit(0)).alias("cell"))


def write_index(index: DataFrame, path: str, files_a_cell: int = 1) -> None:
    """Store an index with a folder for each cell; a cell's rows go to ``files_a_cell`` tasks, so that a large one is several files."""
    salt = F.pmod(F.xxhash64(index.columns[0]), F.lit(files_a_cell))
    index.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("cell", F.col("cell").cast("long"))


def nearest_in(index: DataFrame, centroids: DataFrame, questions: DataFrame, probes: int, k: int = 12, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", question: str = "question_id", question_vector: str = "query", slices: int = 64) -> DataFrame:
    """Per question the ``k`` rows of least distance among those of its ``probes`` nearest cells, ties by key.

    Of a stored index only the probed cells are read: their numbers, at most ``MOST_CELLS``, are a filter on its folders. Up to
    ``BROADCAST_QUESTIONS`` probes are broadcast, more are joined by cell. With as many probes as cells the search is exact.
    """
    asked = questions.select(question, F.col(question_vector).alias("_q"))
    probed = with_cells(asked, centroids, "_q", probes, "_cells", metric).select(question, "_q", F.explode("_cells").alias("cell"))
    cells = [r["cell"] for r in probed.select("cell").distinct().collect()]
    few = asked.limit(BROADCAST_QUESTIONS // max(1, probes) + 1).count() * probes <= BROADCAST_QUESTIONS
    read = index.filter(F.col("cell").isin(cells)) if cells else index.limit(0)
    pairs = read.join(F.broadcast(probed) if few else probed, "cell").select(question, key, METRICS[metric](F.col(vector), F.col("_q")).alias("distance"))
    return best_of_slices(pairs, [question], key, k, slices)


def recall(found: DataFrame, exact: DataFrame, question: str = "question_id", key: str = "vec_id") -> float:
    """The share of exact results that a search has found."""
    hits = exact.select(question, key).join(found.select(question, key).withColumn("_f", F.lit(1)), [question, key], "left")
    return hits.agg(F.avg(F.col("_f").isNotNull().cast("double"))).first()[0]
