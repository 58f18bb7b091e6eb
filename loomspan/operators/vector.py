"""Content-addressed vector collections: ids, upsert, exact search, retrieval and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Questions up to which their vectors are broadcast to all partitions of a collection, or are held against a block of it together.
BROADCAST_QUESTIONS = 10_000
#: Rows of a block of a collection, and distances of a product of matrices that are in memory at once.
BLOCK_ROWS, PRODUCT = 8192, 1 << 21


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def upsert(rows: DataFrame, text: str = "text", call: str = "call", position: str = "pos") -> DataFrame:
    """The collection after upserts: of a call's equal texts the first wins, of several calls the last.

    Both choices are one aggregation each, so no text has all its rows sorted in one task.
    """
    carried = F.struct(*rows.columns)
    keyed = rows.select(content_id(F.col(text)).alias("id"), F.col(call).alias("_call"), F.col(position).alias("_pos"), carried.alias("_row"))
    first = keyed.groupBy("id", "_call").agg(F.min_by("_row", "_pos").alias("_row"))
    last = first.groupBy("id").agg(F.max_by("_row", "_call").alias("_row"))
    return last.select("id", "_row.*")


def size(collection: DataFrame) -> DataFrame:
    """How many rows a collection has."""
    return collection.agg(F.count(F.lit(1)).alias("n"))


def scored_pairs(questions: DataFrame, candidates: DataFrame, score: Callable[[Column, Column], Column], question: str = "question_id") -> DataFrame:
    """Each question's candidates with the score of question and text, as ``top_scored`` takes them; a question without candidates has none."""
    return candidates.join(questions.select(question, "question"), question).withColumn("score", score(F.col("question"), F.col("text"))).drop("question")


def batches(position: Column, size: int = 200) -> Column:
    """The number of the batch a 0-based position falls in."""
    return F.floor(position / size).cast("long")


def nearest(
    collection: DataFrame,
    questions: DataFrame,
    k: int = 12,
    metric: str = "cosine",
    key: str = "vec_id",
    vector: str = "embedding",
    question: list[str] | None = None,
    question_vector: str = "query",
    block_rows: int | None = None,
) -> DataFrame:
    """Exact search: per question the ``k`` rows of least distance, ties by key, which is a number, text or time.

    Every question is held against all rows, in blocks of both: a task takes one block of each, whatever the collection's size, and
    gives its k best a question. Distances are those of ``functions.vectors``, to the last bit. They are null, and come last,
    where a vector is null, has a null or another length, or by cosine is zero.
    """
    by = question or ["question_id"]
    asked = questions.select(*by, F.col(question_vector).alias("_q"))
    n_rows = max(1, -(-collection.count() // (block_rows or BLOCK_ROWS)))
    n_asked = max(1, -(-asked.count() // BROADCAST_QUESTIONS))
    left = collection.select(
        F.col(key), F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), F.lit(n_rows)).cast("int").alias("_rows"), F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("_asked")
    )
    right = asked.withColumns({"_asked": F.pmod(F.xxhash64(*by), F.lit(n_asked)).cast("int"), "_rows": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))})
    schema = T.StructType([*(asked.schema[c] for c in by), collection.schema[key], T.StructField("distance", T.DoubleType())])
    shape = to_arrow_schema(schema)

    def best(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return shape.empty_table()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(key, "ascending")], null_placement="at_start"))
        which, found, distances, none = _block_best(rows["_v"], some["_q"], k, metric)
        columns = [some[c].take(pa.array(which)) for c in by]
        return pa.table([*columns, rows[key].take(pa.array(found)), pa.array(distances, mask=none)], names=shape.names)

    found = left.groupBy("_rows", "_asked").cogroup(right.groupBy("_rows", "_asked")).applyInArrow(best, schema)
    return _ranked(found, by, key, k)


def _matrix(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a width as the columns of a matrix, and the places that they stand at; those with a null are left out."""
    array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(array), width), False))
    flat = pc.list_flatten(array)
    if flat.null_count:
        fits[np.asarray(pc.list_parent_indices(array))[np.asarray(flat.is_null())]] = False
    kept = pc.list_flatten(array.filter(pa.array(fits)))
    return np.ascontiguousarray(np.asarray(kept, np.float64).reshape(int(fits.sum()), width).T), np.flatnonzero(fits)


def _added(a: np.ndarray, b: np.ndarray, term: Callable, n: int) -> np.ndarray:
    """The sum of terms dimension by dimension, in order, as the column functions take it."""
    total = np.zeros(n)
    for x, y in zip(a, b, strict=True):
        total += term(x, y)
    return total


def _block_best(vectors: pa.ChunkedArray, asked: pa.ChunkedArray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """The k nearest of a block's vectors, which are in order of key, for each vector asked: places of both, distances, and which are null.

    A product of matrices gives distances with a rounding error of known bounds. Those that can be among the k least are taken again, exactly.
    """
    widths = np.asarray(pc.fill_null(pc.list_value_length(asked), -1))
    parts = []
    for width in np.unique(widths):
        q, q_at = _matrix(asked, int(width)) if width >= 0 else (np.zeros((0, 0)), np.flatnonzero(widths < 0))
        unfit = np.setdiff1d(np.flatnonzero(widths == width), q_at) if width >= 0 else q_at
        first = np.arange(min(k, len(vectors)))
        parts.append((np.repeat(unfit, len(first)), np.tile(first, len(unfit)), np.zeros(len(unfit) * len(first)), np.full(len(unfit) * len(first), 2)))
        if width < 0 or not len(q_at):
            continue
        x, x_at = _matrix(vectors, int(width))
        others = np.setdiff1d(np.arange(len(vectors)), x_at)[:k]
        with np.errstate(all="ignore"):
            lengths, q_lengths = (np.sqrt(_added(m, m, np.multiply, m.shape[1])) for m in (x, q))
            longest = lengths.max(initial=0.0)
            margin = 8.9e-16 * (width + 8) * {"cosine": np.ones_like(q_lengths), "ip": 1 + longest * q_lengths, "l2sq": (longest + q_lengths) ** 2}[metric]
            step = max(1, PRODUCT // max(1, len(x_at)))
            for start in range(0, len(q_at), step):
                some, n = slice(start, start + step), len(q_at[start : start + step])
                near = q[:, some].T @ x
                if metric == "l2sq":
                    near *= -2.0
                    near += lengths**2
                    near += q_lengths[some, None] ** 2
                else:
                    if metric == "cosine":
                        scale = q_lengths[some, None] * lengths
                        scale[scale < 1e-290] = np.nan
                        near /= scale
                    np.subtract(1.0, near, out=near)
                if len(x_at) > k:
                    most = np.partition(near, k - 1, axis=1)[:, k - 1] + margin[some]
                    i, j = np.nonzero(~(near > most[:, None]))  # what isn't a number is taken again too
                else:
                    i, j = (a.ravel() for a in np.indices((n, len(x_at))))
                a, b = ([m[d] for d in range(width)] for m in (x, q[:, some]))
                if metric == "l2sq":
                    exact = _added(a, b, lambda u, v: (u[j] - v[i]) ** 2, len(i))
                else:
                    exact = _added(a, b, lambda u, v: u[j] * v[i], len(i))
                kind = np.zeros(len(i), np.int64)
                if metric == "cosine":
                    norms = lengths[j] * q_lengths[some][i]
                    kind[norms == 0] = 2
                    exact /= norms
                exact = exact if metric == "l2sq" else 1.0 - exact
                kind[(kind == 0) & np.isnan(exact)] = 1
                parts.append(_least(q_at[some][i], x_at[j], exact, kind, k))
        parts.append((np.repeat(q_at, len(others)), np.tile(others, len(q_at)), np.zeros(len(q_at) * len(others)), np.full(len(q_at) * len(others), 2)))
    which, found, distances, kind = _least(*(np.concatenate(column) for column in zip(*parts, strict=True)), k)
    return which, found, np.where(kind == 1, np.nan, distances), kind == 2


def _least(which: np.ndarray, found: np.ndarray, distances: np.ndarray, kind: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first pairs of each vector asked: numbers by distance, then what isn't a number, then nulls, ties by place."""
    order = np.lexsort((found, np.where(kind > 0, 0.0, distances), kind, which))
    place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
    kept = order[place < k]
    return which[kept], found[kept], distances[kept], kind[kept]


def _in_slices(pairs: DataFrame, by: list[str], key: str, k: int, slices: int) -> DataFrame:
    sliced = pairs.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    partial = Window.partitionBy(*by, "_slice").orderBy(F.asc_nulls_last("distance"), key)
    return sliced.withColumn("_r", F.row_number().over(partial)).filter(F.col("_r") <= k).drop("_r", "_slice")


def _ranked(found: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    final = Window.partitionBy(*by).orderBy(F.asc_nulls_last("distance"), key)
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)


def best_of_slices(pairs: DataFrame, by: list[str], key: str, k: int, slices: int = 64) -> DataFrame:
    """The ``k`` pairs of least distance per question, ties by key: the best of each slice, and of these the best."""
    return _ranked(_in_slices(pairs, by, key, k, slices), by, key, k)


def merge_queries(hits: DataFrame, most: float = 0.75, question: str = "question_id", content: str = "content_id") -> DataFrame:
    """Candidates of each question: hits of its queries within the distance, first seen per content.

    ``hits`` has the query's place in ``query_idx`` and the hit's in ``rank``; a
    missing distance counts as 1. The distance kept is the first query's.
    """
    near = hits.filter(F.coalesce("distance", F.lit(1.0)) <= most)
    order = F.struct("query_idx", "rank")
    first = near.groupBy(question, content).agg(F.min_by("distance", order).alias("distance"), F.min(order).alias("_at"))
    by_place = Window.partitionBy(question).orderBy("_at", content)
    return first.withColumn("position", F.row_number().over(by_place)).select(question, content, "distance", "position", F.col("_at.query_idx").alias("query_idx"))


def top_scored(candidates: DataFrame, k: int = 5, least: float = -2.0, question: str = "question_id", score: str = "score") -> DataFrame:
    """The k best per question, of those the ones that score enough; never more rows in their place.

    If a question has a candidate without a score, its re-ranking has failed as a
    whole: its order is by distance, all its scores are 0 and none is cut.
    """
    failed = F.max(F.col(score).isNull()).over(Window.partitionBy(question))
    marked = candidates.withColumn("_failed", failed)
    best_first = F.when(F.col("_failed"), F.col("distance")).otherwise(-F.col(score))
    order = Window.partitionBy(question).orderBy(best_first, "position")
    given = F.when(F.col("_failed"), F.lit(0.0)).otherwise(F.col(score))
    ranked = marked.withColumns({"rank": F.row_number().over(order), "rerank_score": given})
    return ranked.filter((F.col("rank") <= k) & (F.col("_failed") | (F.col("rerank_score") >= least))).drop("_failed", score)


def best_score(top: DataFrame, questions: DataFrame, question: str = "question_id") -> DataFrame:
    """The best score of every question, 0 where nothing is left."""
    best = top.groupBy(question).agg(F.max("rerank_score").alias("best"))
    return questions.select(question).distinct().join(best, question, "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
