import zlib

import numpy as np
import pytest

from loomspan.llm import quality, toxicity

FILES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{FILES}/documents.parquet"), spark.read.parquet(f"{FILES}/labels.parquet")


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(toxicity, "toxic", 3, 1, 0.93), (quality, "quality", 4, 2, 0.97)])
def test_held_out_accuracy(labelled, module, label, modulus, held, least):
    docs, labels = labelled
    model = module.fit(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (remainder(r.doc_id, modulus) == held) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in tested]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize(("module", "label", "modulus", "held"), [(toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)])
def test_held_out_labels_are_never_read(labelled, module, label, modulus, held):
    """Turning all held-out labels round changes no score."""
    from pyspark.sql import functions as F

    docs, labels = labelled
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
    turned = labels.withColumn(label, F.when(hidden, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r.doc_id: r.score for r in module.score(docs, module.fit(docs, x)).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows(spark, labelled, awkward, empty, module):
    model = module.fit(*labelled)
    got = module.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert module.score(empty, model).collect() == []
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    unlearned = module.fit(labelled[0], nothing)
    assert module.score(awkward, unlearned).count() == awkward.count()


def test_keep_good_keeps_columns(labelled, awkward, empty):
    forest = quality.fit(*labelled)
    assert quality.keep_good(awkward, forest).columns == awkward.columns
    assert quality.keep_good(empty, forest).collect() == []


def test_machine_learns_a_pair_that_no_sum_can(spark):
    """Toxic only where exactly one of two words stands: weights alone can't tell, pairs can."""
    machine = toxicity.Machine(np.arange(2), -2.0, np.array([4.0, 4.0]), np.array([[3.0, 0, 0, 0], [-3.0, 0, 0, 0]]))
    both, one, none = machine.score([np.array([0, 1]), np.array([0]), np.zeros(0, int)])
    assert one > 0.8 and both < 0.2 and none < 0.2
    direct = -2 + 8 + sum(machine.vectors[0] * machine.vectors[1])
    assert both == pytest.approx(1 / (1 + np.exp(-direct)))


def test_training_learns_a_pair_whose_terms_are_balanced(spark):
    """Toxic where both of two words stand or neither; each alone says nothing."""
    r = np.random.default_rng(0)
    rows = []
    for i in range(2000):
        a, b = i % 2, i // 2 % 2
        filler = [f"f{k}" for k in r.choice(40, 8, replace=False)]
        rows.append((" ".join([*filler, *["ab"] * a, *["cd"] * b]), int(a == b)))
    machine = toxicity.train(spark.createDataFrame(rows[:1600], "text string, label int"))
    terms = toxicity.Terms(machine.kept)
    scores = machine.score([terms.of(t) for t, _ in rows[1600:]])
    assert np.mean([(s >= toxicity.TOXIC) == y for s, (_, y) in zip(scores, rows[1600:], strict=True)]) > 0.95


def test_forest_equals_walking_each_row():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:50], forest.score(x[:50]), strict=True):
        raw = forest.base
        for node in forest.roots:
            while forest.left[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
            raw += forest.value[node]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))
