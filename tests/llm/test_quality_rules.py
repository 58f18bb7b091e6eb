import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def grams(text):
    """Hashes of words and of adjacent pairs, by the public xxHash64 with Spark's seed 42."""
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    eight = lambda x: x.to_bytes(8, "little", signed=True)
    pairs = [signed(xxhash.xxh64_intdigest(eight(b), xxhash.xxh64_intdigest(eight(a), 42))) for a, b in zip(hashes, hashes[1:])]
    return [x % rules.BINS for x in hashes + pairs]


def texts():
    rng = random.Random(4)
    some = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 200))) for _ in range(40)]
    return some + [None, "", " \t\n", "\x0b\x0ca b", "one\ntwo\none\n\n \none", "a b c a b c", "a a a a", "a b a b a", "# $ | <x> ééé &", "word", "x\r\ny\r\nx", "w " * 3000, " ".join(map(str, range(3000)))]


def test_base_counts_equal_loops(spark):
    rows = list(enumerate(texts()))
    got = rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: counts(t) for i, t in rows}


def test_ratios_and_scores_equal_loops(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 20)], "doc_id long")
    ratios = rules.fit(docs, trusted)
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        good.update(grams(t) if i < 20 else [])
    p = rules.PRIOR
    all_raw, all_good = sum(raw.values()) + p * rules.BINS, sum(good.values()) + p * rules.BINS
    want = [math.log((good[b] + p * rules.BINS * (raw[b] + p) / all_raw) / all_good / ((raw[b] + p) / all_raw)) for b in range(rules.BINS)]
    assert ratios == pytest.approx(want, abs=1e-9)
    for r in rules.rules(docs, ratios).collect():
        found = grams(dict(rows)[r.doc_id])
        score = sum(want[b] for b in found) / len(found) if found else 0.0
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == (not r.base_failed and score >= rules.THRESHOLD)


def test_junk_goes_and_prose_stays(spark):
    """Labels that weren't trusted text: a document's own label doesn't make its score."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    ratios = rules.fit(docs, rules.trusted_ids(labels.filter(other)))
    judged = rules.rules(docs, ratios).join(labels.filter(~other), "doc_id").filter("NOT base_failed")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_awkward_rows_and_no_trusted_text(spark, awkward, empty):
    ratios = rules.fit(awkward, spark.createDataFrame([], "doc_id long"))
    assert set(ratios) == {0.0} and len(ratios) == rules.BINS
    got = rules.rules(awkward, ratios).collect()
    assert len(got) == awkward.count() and sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in awkward.collect())
    assert all(r.kept != r.base_failed and r.score == 0.0 for r in got)
    assert rules.rules(empty, rules.fit(empty, spark.createDataFrame([], "doc_id long"))).collect() == []


def test_trusted_ids_are_bounded_and_undisputed(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in rules.trusted_ids(labels).collect()) == [1, 5] and rules.trusted_ids(labels, 1).count() == 1


def test_all_good_labels_are_counted(spark):
    """More labels than a fixed number are all trusted, whatever the number."""
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    ids = rules.trusted_ids(labels)
    assert ids.count() == 30_000
    docs = labels.select("doc_id", F.when(F.col("doc_id") < 29_000, "common words here").otherwise("rare terms there").alias("text"))
    counts = Counter({b: 29_000 * n for b, n in Counter(grams("common words here")).items()}) + Counter({b: 1000 * n for b, n in Counter(grams("rare terms there")).items()})
    raw = [counts[b] for b in range(rules.BINS)]
    assert rules.fit(docs, ids) == pytest.approx(rules._ratios(raw, raw), abs=1e-9)


def test_main_path_has_no_python(spark, awkward):
    plan = rules.rules(awkward, [0.0] * rules.BINS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_trusted_ids_leave_the_other_texts_in_place(spark, tmp_path):
    """Trusted ids beyond the broadcast threshold: texts of other documents aren't shuffled, and counts are those of loops."""
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    texts.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    ids = spark.range(0, 20_000, 10).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(None,), (0,), (10**6,)], "doc_id long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = rules._that_may_be(docs, ids)
        got = sorted(r.text for r in near.collect())
        executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
        written = lambda: sum(executors().apply(i).totalShuffleWrite() for i in range(executors().size()))
        start = written()
        ratios = rules.fit(docs, ids)
        moved = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wanted = [r.text for r in docs.filter("doc_id % 10 = 0").collect()]
    assert got == sorted(wanted) and moved < 20_000 * 64
    raw, good = Counter(), Counter()
    for r in docs.collect():
        raw.update(grams(r.text))
    for t in wanted:
        good.update(grams(t))
    assert ratios == pytest.approx(rules._ratios([raw[b] for b in range(rules.BINS)], [good[b] for b in range(rules.BINS)]), abs=1e-9)
