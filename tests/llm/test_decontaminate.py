import hashlib
import random

from loomspan.llm import decontaminate
from loomspan.llm.common import word_bytes


def brute(docs, items):
    out = {}
    for i, text in docs:
        words, hit, found = word_bytes(text), set(), set()
        for item, t in items:
            w = word_bytes(t)
            k = min(10, len(w))
            for s in range(len(w) - k + 1 if k else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        names = ",".join(sorted(found))
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def tables(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 10, 14, 30])))) for i in range(1, 15)] + [(20, ""), (21, None), (None, "no id"), (22, "the the the")]
    docs = []
    for i in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w = items[i % 14][1].split()
            cut = r.randint(0, max(0, len(w) - 10))
            words[5:5] = w[cut : cut + 12]
        docs.append((i, " ".join(words).upper() if i % 2 else ", ".join(words)))
    docs += [(100, None), (101, "")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def digests(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(frame).collect()}


def test_equals_brute_force(spark):
    docs, items, d, b = tables(spark)
    assert digests(decontaminate.find_matches(d, b)) == brute(docs, [x for x in items if x[0] is not None])


def test_a_crowded_bit_set_gives_the_same(spark, monkeypatch):
    docs, items, d, b = tables(spark)
    monkeypatch.setattr(decontaminate, "SET_BITS", 16)
    assert digests(decontaminate.find_matches(d, b)) == brute(docs, [x for x in items if x[0] is not None])


def test_proximity(spark):
    item = "zeta one two three four five six seven kappa omega"
    near = "x zeta one two three extra four five six seven kappa omega y"
    d = spark.createDataFrame([(1, near), (2, item), (3, "zeta nothing kappa")], "doc_id long, text string")
    hits = {r.doc_id: [h.exact for h in r.hits] for r in decontaminate.find_matches(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: [False], 2: [True], 3: []}


def test_awkward_rows(spark, awkward, empty):
    _, _, _, b = tables(spark)
    assert decontaminate.digest(decontaminate.find_matches(awkward, b)).count() == awkward.count()
    assert decontaminate.find_matches(empty, b).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_matches(awkward, none)).filter("contaminated").count() == 0
    assert decontaminate.remove_contaminated(awkward, none).columns == awkward.columns
    own = spark.createDataFrame([(1, "longish text with 7 numbers word8 longish text with 8 numbers")], "item_id long, text string")
    assert decontaminate.remove_contaminated(awkward, own).count() == awkward.count() - 2


def test_documents_with_a_whole_short_item_are_removed(spark):
    items = spark.createDataFrame([(1, "zeta kappa omega"), (2, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x zeta kappa omega y"), (2, "zeta kappa"), (3, "and one more"), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()} == {2, 4}
