"""Toxicity by a factorization machine over hashed terms.

A term is a word, or one of a word's beginnings with a mark. Each has a weight and a
short vector; a document's score sums its terms' weights and the inner products
of all pairs of its terms' vectors, which costs no more than the sum itself. So
an insult beside a mention of a group can count for more than both alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow, word_bytes
from loomspan.llm.labels import held_out, training_rows

#: Hash buckets of terms, length of a vector, bytes of a word's beginnings.
BUCKETS, FACTORS, BEGINNINGS = 1 << 20, 4, (4, 5, 6)
#: Labelled rows learned from at most (a documented bound), and the rows a term must be in.
TRAINING_ROWS, LEAST_ROWS = 12_000, 4
#: Terms whose share of toxic rows is so many standard errors off the whole's are fitted first; then all are.
FIRST_ERRORS = 5.0
#: Step, before it is divided by the root of a row's terms, and decay of the fit of all terms.
REST_RATE, REST_DECAY = 0.05, 0.5
#: Labels are learned only from rows whose crc32 modulo 3 is not 1.
MODULUS, REMAINDER = 3, 1
#: Score from which a row is predicted toxic.
TOXIC = 0.7
#: Words a worker remembers, and rows of an output batch.
REMEMBERED, ROWS = 300_000, 512


def terms_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    return (zlib.crc32(word) % BUCKETS, *[zlib.crc32(word[:n], 1) % BUCKETS for n in BEGINNINGS if len(word) > n])


class Terms(dict):
    """Word -> numbers of its terms among the kept ones; remembers up to a bound."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        super().__init__()
        self.number = None if kept is None else {int(b): i for i, b in enumerate(kept)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = terms_of(word)
        if self.number is not None:
            found = tuple(self.number[b] for b in found if b in self.number)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The distinct terms of a text, sorted."""
        return np.array(sorted(set(chain.from_iterable(map(self.__getitem__, set(word_bytes(text)))))), np.int64)


class Machine:
    """Weights, vectors and bias over the kept buckets."""

    def __init__(self, kept: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.kept, self.bias, self.weights, self.vectors = kept, bias, weights, vectors

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, from the sum and the sum of squares of each row's vectors."""
        lengths = np.array([len(r) for r in rows])
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        raw = np.full(len(rows), self.bias)
        full = np.flatnonzero(lengths)
        if len(full):
            begin = (np.cumsum(lengths) - lengths)[full]
            v = self.vectors[ids]
            sums, squares = np.add.reduceat(v, begin), np.add.reduceat(v * v, begin)
            raw[full] += np.add.reduceat(self.weights[ids], begin) + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: DataFrame, rounds: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Fit a machine to ``text`` and ``label`` rows, of which there must be boundedly many.

    Executors turn texts into buckets. The driver keeps all terms that stand in
    ``LEAST_ROWS`` rows, whatever their labels, as some count only in pairs. The terms
    whose share of toxic rows stands out are fitted first, so that all the others
    have only what these leave unexplained to learn, in smaller steps and against decay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            buckets = [terms.of(t).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), batch.column("label")], names=["terms", "label"])

    data = sorted((bytes(r["terms"]), r["label"]) for r in map_arrow(rows, run, "terms binary, label int").collect())
    if not data or len({y for _, y in data}) < 2:
        share = float(np.mean([y for _, y in data])) if data else 0.0
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    return learn([np.frombuffer(t, np.int32) for t, _ in data], np.array([v for _, v in data], float), rounds, rate, decay, seed)


def learn(x: list[np.ndarray], y: np.ndarray, rounds: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Machine:
    """The machine of rows of distinct buckets and their labels, of both kinds."""
    counts = np.bincount(np.concatenate(x), minlength=BUCKETS)
    share = y.mean()
    kept = np.flatnonzero(counts >= LEAST_ROWS)
    toxic = np.bincount(np.concatenate(x), np.repeat(y, [len(t) for t in x]), BUCKETS)[kept]
    stands_out = np.abs(toxic - counts[kept] * share) >= FIRST_ERRORS * np.sqrt(counts[kept] * share * (1 - share))
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    x = [(n := number[t])[n >= 0] for t in x]
    r = np.random.default_rng(seed)
    machine = Machine(kept, float(np.log(share / (1 - share))), np.zeros(len(kept)), r.normal(0, 0.02, (len(kept), FACTORS)))
    if len(kept):
        if stands_out.any():
            _descend(machine, [t[stands_out[t]] for t in x], y, r, rounds, rate, 0.1 * rate, 1e-4, decay)
        smaller = 1 / np.sqrt(max(1.0, np.mean([len(t) for t in x])))
        _descend(machine, x, y, r, rounds, REST_RATE * smaller, 2.5 * REST_RATE * smaller, 1.0, REST_DECAY)
    return machine


def _descend(machine: Machine, x: list[np.ndarray], y: np.ndarray, r: np.random.Generator, rounds: int, rate_w: float, rate_v: float, start: float, decay: float) -> None:
    """Adaptive gradient steps over batches of rows ``x``; ``decay`` draws back to where they began."""
    kept, first_w, first_v = machine.kept, machine.weights.copy(), machine.vectors.copy()
    square_w, square_v, square_b = np.full(len(kept), start), np.full((len(kept), FACTORS), start), start
    for _ in range(rounds):
        order = r.permutation(len(x))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            rows_x = [x[i] for i in part]
            error = machine.score(rows_x) - y[part]
            ids = np.concatenate(rows_x)
            used, inverse = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(part)), [len(a) for a in rows_x])
            v = machine.vectors[ids]
            sums = np.stack([np.bincount(owner, v[:, f], len(part)) for f in range(FACTORS)], 1)
            e = error[owner]
            grad_w = np.bincount(inverse, e, len(used))
            pull = (sums[owner] - v) * e[:, None]
            grad_v = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(FACTORS)], 1)
            square_w[used] += grad_w**2
            square_v[used] += grad_v**2
            square_b += error.sum() ** 2
            machine.weights[used] -= rate_w * (grad_w + decay * (machine.weights[used] - first_w[used])) / np.sqrt(square_w[used])
            machine.vectors[used] -= rate_v * (grad_v + decay * (machine.vectors[used] - first_v[used])) / np.sqrt(square_v[used])
            machine.bias -= rate_w * error.sum() / np.sqrt(square_b)


def fit(docs: DataFrame, labels: DataFrame, at_most: int = TRAINING_ROWS) -> Machine:
    """The machine for ``labels.toxic``, learned from rows that aren't held out."""
    return train(training_rows(docs, labels, "toxic", MODULUS, REMAINDER, at_most))


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    Only the text is read for the score. Null and empty texts get the score of
    no terms at all. Null ids aren't held out; repeated rows are scored alike; a text of any length is
    read whole; other columns are not kept; an empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(id_column).try_cast("long").alias("doc_id"), held_out(F.col(id_column), MODULUS, REMAINDER).alias("held_out"), F.col(text_column).alias("text")
    )
    kept, bias, weights, vectors = machine.kept, machine.bias, machine.weights, machine.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(kept), Machine(kept, bias, weights, vectors)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                scores = model.score([terms.of(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= TOXIC).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return map_arrow(narrow, run, "doc_id long, held_out boolean, score double, predicted int")
