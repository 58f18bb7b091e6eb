import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspan.llm import sharding
from loomspan.llm.sharding import shards


def test_awkward_rows(awkward):
    got = shards(awkward, n_shards=5).collect()
    assert len(got) == awkward.count()
    want = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)


def test_empty_table(empty):
    assert shards(empty, n_shards=5).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_sizes_are_near_equal(spark, n):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.rpad(F.col("id").cast("string"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int") + 4, F.lit("x")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 17).cast("string"))).alias("source"),
        F.lit("en").alias("lang"),
    )
    sizes = [r["b"] for r in shards(docs, n_shards=n).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == n and max(sizes) - min(sizes) <= 0.06 * sum(sizes) / n + 2 * 66


def test_target_bytes(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("text"))
    found = shards(docs, target_bytes=2600).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(found) == 10 and all(abs(r.b - 2600) <= 52 for r in found)


def brute_tree(points, shards, first=0, out=None):
    """Shard of each point (name, bytes, keys) by sorting, with no histograms."""
    out = {} if out is None else out
    if shards == 1 or not points:
        out.update({name: first for name, _, _ in points})
        return out
    spans = [(max(k[a] for *_, k in points) >> 32) - (min(k[a] for *_, k in points) >> 32) for a in range(len(points[0][2]))]
    axis = max(range(len(spans)), key=lambda a: spans[a])
    by_key = {}
    for _, size, keys in points:
        by_key[keys[axis]] = by_key.get(keys[axis], 0) + size
    target, below, threshold = sum(by_key.values()) * (shards // 2) / shards, 0, -1
    for key in sorted(by_key):
        if below + by_key[key] >= target:
            threshold = key if target - below >= by_key[key] / 2 else threshold
            break
        below, threshold = below + by_key[key], key
    half = shards // 2
    brute_tree([p for p in points if p[2][axis] <= threshold], half, first, out)
    return brute_tree([p for p in points if p[2][axis] > threshold], shards - half, first + half, out)


@pytest.mark.parametrize("n", [2, 5, 12])
def test_tree_equals_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BINS", 8)
    monkeypatch.setattr(sharding, "BINS", 16)
    r = random.Random(n)
    seen = [(f"t{i}".encode(), 0, r.randint(16, 900), [r.choice([5, 5, 90, r.randint(0, 1000)]) << 32 | r.randrange(1 << 32) for _ in range(3)]) for i in range(400)]
    points = spark.createDataFrame(seen, "_text binary, _part long, bytes long, _keys array<long>")
    nodes, depth = sharding.build_tree(points, n, 3)
    route = F.get(F.array(*[F.lit(x.first) for x in nodes]), sharding._route(nodes, depth))
    got = {bytes(x._text): x.s for x in points.select("_text", route.alias("s")).collect()}
    assert got == brute_tree([(name, size, keys) for name, _, size, keys in seen], n)


def test_equal_texts_stay_together_unless_they_fill_shards(spark):
    texts = [f"text number {i} " * (1 + i % 7) for i in range(1500)]
    rows = [(i, t, f"s{i % 13}", "en") for i, t in enumerate(texts)]
    rows += [(2000 + 10 * i + k, texts[i], f"s{(i + k) % 13}", "de") for i in range(0, 300, 3) for k in range(1 + i % 4)]
    rows += [(10_000 + i, "a very common text", "hot", "en") for i in range(2500)]  # a third of all bytes
    rows += [(77, "one id and one text", "hot", "en")] * 1200
    got = shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), n_shards=12).collect()
    size, of = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        of.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(size.values()) / 12
    assert len(size) == 12 and max(size.values()) - min(size.values()) <= 0.3 * mean, size
    common, repeated = (zlib.crc32(t) for t in (b"a very common text", b"one id and one text"))
    assert len(of.pop(common)) > 1 and len(of.pop(repeated)) > 1
    assert all(len(s) == 1 for s in of.values())


def test_skewed_sizes_are_near_equal(spark):
    docs = spark.range(8000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.col("id").cast("string"), F.repeat(F.lit("y"), F.pow(F.lit(1.0009), F.pmod(F.xxhash64("id"), F.lit(8000))).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 17).cast("string"))).alias("source"),
        F.lit("en").alias("lang"),
    )
    sizes = [r["b"] for r in shards(docs, n_shards=40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 40
