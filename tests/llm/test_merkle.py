import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place string, hash string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(field, row))


def levels(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def path(rows, i):
    for row in rows[:-1]:
        run = i - i % 3
        yield row[run:i], row[i + 1 : run + 3]
        i //= 3


def brute(rows):
    """The contract by plain loops: trees level by level, proofs, and folding of tampered leaves."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        listed = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = listed, levels([leaf(r) for r in listed])
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        listed, tree = trees[s]
        for i, r in enumerate(listed):
            steps = [*path(tree, i), *path(top, j)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf((*r[:4], text))
            for left, right in steps:
                now = h(*left, now, *right)
            proof = h(*[x for left, right in steps for x in (*left, *right)])
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "t", "p", "h") for r in rows], SCHEMA)
    got = merkle.manifest(docs, merkle.without_newlines(F.col("doc_id"), F.col("text")), **more).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


def documents(seed, sizes):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        rows += [(i, source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["a\nb", "c", "", None, "é\n"])) for i in rng.sample(range(10**6), n)]
    return rows


def test_equals_loops(spark):
    rows = documents(1, {"a": 1, "b": 2, "c": 3, "d": 4, "é": 28, None: 10, "": 1, "big": 800})
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_layers_of_superblocks(spark, levels):
    """Superblocks of three or nine nodes, so that trees take several layers."""
    rows = documents(2, {"x": 100, "y": 3, "z": 31, **{f"s{i:02d}": 1 for i in range(40)}})
    assert run(spark, rows, levels=levels) == brute(rows)


def test_one_source_one_row_and_none(spark):
    one = [(7, "s", "en", 3, "a\nb")]
    assert run(spark, one) == brute(one) and run(spark, one)[0][2] == run(spark, one)[0][1]
    assert run(spark, []) == []


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()] + [(2**62 + 1, "s", None, None, None), (None, None, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_untampered_rows_verify(spark, awkward):
    got = merkle.manifest(awkward).collect()
    assert len(got) == awkward.count() and all(r.verified for r in got)


def test_any_change_is_seen(spark):
    rows = documents(3, {"a": 20, "b": 5})
    docs = spark.createDataFrame([(*r, "t", "p", "h") for r in rows], SCHEMA)
    got = merkle.manifest(docs, F.concat(F.coalesce("text", F.lit("")), F.lit(" "))).collect()
    assert len(got) == 25 and not any(r.verified for r in got)
