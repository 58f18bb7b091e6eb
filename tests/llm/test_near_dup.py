import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import near_dup
from loomspan.llm.common import word_bytes
from loomspan.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_equals_dynamic_programming():
    r = random.Random(5)
    for _ in range(4000):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = list(a) if r.random() < 0.7 else [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randint(0, 3))
            if b and r.random() < 0.5:
                del b[r.randrange(len(b))]
        limit, d = r.randint(0, 8), distance(a, b)
        assert near_dup.alignment_distance(np.array(a, int), np.array(b, int), limit) == (d if d <= limit else None)


def test_sketches_follow_order_and_occurrence():
    r = np.random.default_rng(2)
    words = r.integers(1, 2**63, 300).astype(np.uint64)
    turned = np.concatenate([words[150:], words[:150]])
    own = near_dup.sketches(words)
    assert (own == near_dup.sketches(words.copy())).all()
    assert 0 < (own == near_dup.sketches(turned))[: near_dup.SKETCHES].sum() < near_dup.SKETCHES  # the same k-mers but for a few, in another order
    kmers = near_dup.labelled_kmers(np.tile(words[:6], 5))
    assert len(set(kmers.tolist())) == len(kmers)


def corpus(seed=8):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs, n = [], 0
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for group in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120, 300]))]
        for copy in range(r.choice([1, 1, 2, 3, 60 if group == 3 else 2])):
            words = list(base)
            for _ in range(int(len(words) * 0.03) if copy else 0):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append((n, " ".join(words)))
            n += 1
    for _ in range(60):  # different texts that share a long passage
        docs.append((n, " ".join(r.choice(vocabulary) for _ in range(120)) + " " + passage))
        n += 1
    return docs


def test_classes_equal_brute_force(spark):
    docs = corpus()
    words = {i: np.array([hash(w) for w in word_bytes(t)]) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in docs:
        for j in range(i):
            if near_dup.similar(words[i], words[j]) is not None:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: got[i].class_id for i in got} == {i: find(i) for i, _ in docs}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


@pytest.mark.parametrize(("length", "changed"), [(300, 60), (300, 45), (300, 30), (100, 20), (10, 1)])
def test_recall_of_scattered_changes(length, changed):
    """Of texts at the least alignment, 0.8, and above, nearly all pairs share a sketch."""
    r = np.random.default_rng(6)
    met = 0
    for _ in range(200):
        a = r.integers(1, 2**63, length).astype(np.uint64)
        b = a.copy()
        b[r.choice(length, changed, replace=False)] = r.integers(1, 2**63, changed)
        one, two = near_dup.sketches(a), near_dup.sketches(b)
        met += bool((one == two).any())
    print(length, changed, met)
    assert met >= 180


def test_short_texts_at_the_least_similarity_are_found(spark):
    """Pairs of 5 to 60 words that differ by as many words as 0.8 allows: replaced, left out and put in."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, kinds = [], []
    for length in (5, 8, 10, 12, 15, 20, 30, 60):
        for kind in ("replaced", "left out", "put in"):
            for _ in range(12):
                one = [word() for _ in range(length)]
                other = list(one)
                d = int(0.2 * length + 1e-9) if kind != "put in" else int(0.25 * length + 1e-9)
                for at in sorted(rng.sample(range(length), d), reverse=True):
                    if kind == "replaced":
                        other[at] = word()
                    elif kind == "left out":
                        del other[at]
                    else:
                        other.insert(at, word())
                rows += [(2 * len(kinds), " ".join(one)), (2 * len(kinds) + 1, " ".join(other))]
                kinds.append((length, kind))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [kinds[i] for i in range(len(kinds)) if got[2 * i] != got[2 * i + 1]]
    assert not [m for m in missed if m[0] <= near_dup.SHORTEST] and len(missed) <= len(kinds) // 20
    assert all(sum(m == k for m in missed) <= 1 for k in set(kinds))  # of twelve
    assert len(set(got.values())) == len(kinds) + len(missed)


def test_large_bucket_of_distinct_classes_links_all_similar_texts(spark):
    """Forty pairs of near copies about a common passage that share one large bucket and nothing else."""
    r = np.random.default_rng(11)
    passage = r.integers(0, 2**31, 60)
    texts = {}
    for i in range(40):
        own = np.concatenate([r.integers(0, 2**31, int(r.integers(30, 160))), passage])
        other = own.copy()
        spots = r.choice(len(own) - 60, int(0.15 * len(own)), replace=False)
        other[spots] = r.integers(0, 2**31, len(spots))
        texts[f"{i}a"], texts[f"{i}b"] = own, other
    rows = [(i, name, len(t), [77], near_dup.marks(t.astype(np.uint64)).tolist(), t.astype(int).tolist()) for i, (name, t) in enumerate(texts.items())]
    printed = spark.createDataFrame(rows, "id long, node string, n_words int, sketches array<long>, marks array<long>, terms array<int>")
    names = list(texts)
    found = {(names[x.a], names[x.b]) for x in near_dup.links(printed, printed).collect()}
    assert found == {(a, b) for a in names for b in names if a < b and near_dup.similar(texts[a], texts[b]) is not None}
    assert len(found) == 40


def test_large_bucket_is_compared_in_parts_and_writes_only_pairs_that_can_be_similar(spark, monkeypatch):
    """Different texts of repeated words in one bucket, as stretched ones are: their pairs grow with the square, what is written doesn't."""
    monkeypatch.setattr(near_dup, "TOGETHER", 16)
    r = np.random.default_rng(4)
    texts = [np.repeat(r.integers(0, 2**31, 10), 22)[: int(r.integers(150, 220))] for _ in range(120)]
    texts += [np.concatenate([t[:-20], r.integers(0, 2**31, 20)]) for t in texts[:30]]
    texts += [np.arange(600), np.arange(500), np.arange(300), np.arange(250)]  # marks of three sizes
    rows = [(i, len(t), i, [0], near_dup.marks(t.astype(np.uint64)).tolist(), len(texts)) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "id long, n_words int, root long, k array<int>, marks array<long>, _n long")
    met = [tuple(x) for x in near_dup._pairs_of_large(nodes.select("id", "n_words", "root", F.lit(0).alias("k"), "_n"), ["k"], nodes).collect()]
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if near_dup.similar(texts[a], texts[b]) is not None}
    assert len(met) == len(set(met)) and alike <= set(met) and len(alike) >= 32
    assert len(met) < 2 * len(alike)  # of 11,781 pairs
    rows = nodes.select("id", "n_words", "root", F.lit(0).alias("k"), "_n")
    near = [tuple(x) for x in near_dup._pairs_of_large(rows, ["k"], nodes, nearest=True).collect()]
    assert set(near) <= set(met) and 0 < len(near) < len(met)
    assert "explode" not in near_dup._pairs_of_large(rows, ["k"], nodes, nearest=True)._jdf.queryExecution().toString()
    same = nodes.withColumn("root", F.lit(7))
    assert near_dup._pairs_of_large(same.select("id", "n_words", "root", F.lit(0).alias("k"), "_n"), ["k"], nodes).count() == 0


def test_a_repeated_kmer_changes_no_other(spark):
    """A first occurrence is the same k-mer whether or not others are repeated; short texts were not linked before."""
    words = np.arange(1, 40, dtype=np.uint64)
    for k in (1, 2, 3, 5):
        once, twice = near_dup.labelled_kmers(words, k), near_dup.labelled_kmers(np.concatenate([words, words[:k]]), k)
        assert set(once.tolist()) < set(twice.tolist()) and len(set(twice.tolist())) == len(twice)
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i a b c")]  # a b c twice
    rows += [(i + 2, t.replace("a b c d", "x b c d")) for i, t in rows]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}


def test_marks_rule_out_no_similar_pair(spark):
    """Edits of all kinds up to the limit, in few and in many distinct words, and pairs that have nothing in common."""
    r = random.Random(3)
    nodes, pairs = [], []
    for n in [1, 2, 4, 5, 6, 10, 40, 200, 900] * 20:
        words = r.choice([3, 50, 10**6])
        a = [r.randrange(words) for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, n // 5 + 1)):
            kind, at = r.randrange(3), r.randint(0, len(b))
            b[at : at + (kind > 0)] = [r.randrange(words)] * (kind < 2)
        for t in (a, b, [r.randrange(10**6) for _ in range(n)]):
            nodes.append((len(nodes), len(t), near_dup.marks(np.array(t, np.uint64)).tolist(), t))
        pairs += [(len(nodes) - 3, len(nodes) - 2), (len(nodes) - 3, len(nodes) - 1)]
    table = spark.createDataFrame([x[:3] for x in nodes], "id long, n_words int, marks array<long>")
    kept = {tuple(x) for x in near_dup._plausible(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    alike = {(a, b) for a, b in pairs if near_dup.similar(np.array(nodes[a][3]), np.array(nodes[b][3])) is not None}
    assert alike <= kept and 100 < len(alike)
    assert sum((a, b) in kept for a, b in pairs[1::2]) < 60  # most of those with nothing in common


def test_found_links_span_their_class(spark):
    """``n_found`` counts found links only: of a class of m texts at least m - 1 have been found."""
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.columns == ["doc_id", "class_id", "class_size", "n_found", "kept"]
    rows = got.collect()
    assert {r.class_size for r in rows} == {40}
    assert sum(r.n_found for r in rows) >= 2 * 39 and all(1 <= r.n_found <= 39 for r in rows)


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (1, a), (None, c), (None, c), (0, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()) == [(0, c), (1, a), (5, b)]


def test_awkward_rows(awkward, empty):
    got = near_dup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    texts = {r.doc_id: r.text for r in awkward.collect()}
    long_ids = [i for i, t in texts.items() if t and len(t) > 1000]
    assert {by_id[i].class_id for i in long_ids} == {min(long_ids)}
    assert all(r.class_size == 1 and r.kept for r in got if not word_bytes(texts[r.doc_id]))
    assert near_dup.near_duplicates(empty).collect() == []
    assert near_dup.keep_one(awkward).columns == awkward.columns and near_dup.keep_one(empty).collect() == []


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 2), (3, 4), (4, 2), (9, 8)]])
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}
    for _ in range(50):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == parent
