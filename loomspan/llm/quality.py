"""Quality by histogram gradient-boosted trees over document statistics.

A text becomes a row of statistics: shares of kinds of characters, of repeated
words and lines, lengths. Trees are grown on binned statistics of a bounded
labelled sample, then flattened into arrays, so that scoring walks all rows of a
batch through a tree together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow
from loomspan.llm.labels import held_out, training_rows

#: Statistics of a text, in the order of their columns.
STATISTICS = (
    "characters", "words", "word length", "upper case", "lower case", "digits", "blanks", "stops", "symbols", "beyond ascii",
    "distinct words", "words repeated at once", "lines", "distinct lines", "words of symbols only", "words ending in a symbol",
)
#: Bins of a statistic, trees, depth of a tree, rate of learning, least rows of a leaf.
BINS, TREES, DEPTH, RATE, LEAF = 64, 60, 4, 0.15, 8
#: Labelled rows learned from at most (a documented bound).
TRAINING_ROWS = 20_000
#: Labels are learned only from rows whose crc32 modulo 4 is not 2.
MODULUS, REMAINDER = 4, 2
#: Score from which a row is predicted good.
GOOD = 0.7
ROWS = 512

_CLASS = np.full(256, 5, np.int64)
_CLASS[0x80:] = 6
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b" \t\r\n"]] = 3
_CLASS[[*b".,;:?"]] = 4
#: Maps letters, digits and bytes beyond ASCII to a, blanks to themselves, all else to a mark.
_KINDS = bytes(0x61 if _CLASS[b] in (0, 1, 2, 6) else 0x20 if _CLASS[b] == 3 else 0x2E if _CLASS[b] == 4 else 0x23 for b in range(256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all zero for a null or empty one."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    words, lines = data.split(), data.split(b"\n")
    kinds = data.translate(_KINDS).split()
    n, m = len(data), max(1, len(words))
    at_once = sum(map(bytes.__eq__, words, words[1:]))
    symbols = sum(1 for k in kinds if not k.strip(b"#."))
    ending = sum(1 for k in kinds if k[-1] == 0x23)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - counts[3]) / m, counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n,
        counts[4] / n, counts[5] / n, counts[6] / n, len(set(words)) / m, at_once / m, float(np.log1p(len(lines))),
        len(set(lines)) / len(lines), symbols / m, ending / m,
    ]


@dataclass
class Forest:
    """All trees in arrays: a node's statistic, threshold, left child and value; the right child follows the left."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):  # leaves lead to themselves
                inner = self.left[at] >= 0
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            raw += self.value[at]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boost trees on the logistic loss, splitting at the best of each statistic's bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n_features = x.shape[1]
    feature, threshold, left, value, roots = [], [], [], [], []

    def new_node() -> int:
        for column, empty in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    raw = np.full(len(y), base)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = p - y, p * (1 - p)
        at = np.full(len(y), new_node())
        roots.append(at[0])
        level = [int(at[0])]
        for depth in range(DEPTH + 1):
            following = []
            for node in level:
                rows = np.flatnonzero(at == node)
                g, h = gradient[rows], hessian[rows]
                value[node] = float(-RATE * g.sum() / (h.sum() + 1.0))
                if depth == DEPTH or len(rows) < 2 * LEAF:
                    continue
                cell = (binned[rows] + np.arange(n_features) * BINS).ravel()
                size = n_features * BINS
                hist = [np.bincount(cell, w, size).reshape(n_features, BINS).cumsum(1) for w in (np.repeat(g, n_features), np.repeat(h, n_features), np.ones(len(cell)))]
                (gl, hl, nl), total = hist, (g.sum(), h.sum(), len(rows))
                gain = gl**2 / (hl + 1) + (total[0] - gl) ** 2 / (total[1] - hl + 1) - total[0] ** 2 / (total[1] + 1)
                gain[(nl < LEAF) | (total[2] - nl < LEAF)] = -1
                f, b = divmod(int(gain.argmax()), BINS)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[node], threshold[node], left[node] = f, float(edges[f][b]), new_node()
                new_node()
                at[rows] = left[node] + (binned[rows, f] > b)
                following += [left[node], left[node] + 1]
            level = following
        raw += np.array(value)[at]
    return Forest(base, np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(value))


def _measured(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                x = [statistics(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return map_arrow(rows, run, ", ".join([*fields, "x array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = TRAINING_ROWS) -> Forest:
    """The forest for ``labels.quality``, learned from rows that aren't held out."""
    sample = training_rows(docs, labels, "quality", MODULUS, REMAINDER, at_most)
    rows = sorted((tuple(r["x"]), r["label"]) for r in _measured(sample, ("label",)).collect())
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return grow(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    Only the text is read for the score; null and empty texts have all
    statistics zero. Null ids aren't held out; repeated rows are scored alike; a text of any length is
    read whole; other columns are not kept; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_column).try_cast("long").alias("doc_id"), held_out(F.col(id_column), MODULUS, REMAINDER).alias("held_out"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                scores = _scores(batch, "text", forest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= GOOD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return map_arrow(narrow, run, "doc_id long, held_out boolean, score double, predicted int")


def _scores(batch: pa.RecordBatch, text_column: str, forest: Forest) -> np.ndarray:
    x = [statistics(t) for t in batch.column(text_column).to_pylist()]
    return forest.score(np.array(x, float).reshape(len(x), len(STATISTICS)))


def keep_good(docs: DataFrame, forest: Forest, least: float = GOOD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns, whatever their names.

    A null text is scored as an empty one, null ids and repeated rows as any others, a text of any length whole; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                yield batch.filter(pa.array(_scores(batch, text_column, forest) >= least))

    return map_arrow(docs, run, docs.schema)
