import random

from pyspark.sql import functions as F

from loomspan import session
from loomspan.operators import evaluation, graph, keywords


def pairs(spark, texts, words):
    got = keywords.containments(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(w,) for w in words], "keyword string"))
    return sorted((r.text_id, r.keyword) for r in got.collect())


def wanted(texts, words):
    return sorted({(i, w) for i, t in enumerate(texts) for w in words if t is not None and w is not None and w.lower() in t.lower()})


def test_equals_a_search_of_every_text(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB ñ|") for _ in range(n))
    texts = [text(rng.randrange(0, 40)) for _ in range(120)] + ["", None, "x" * 5000 + "needle", "NEEDLE", "a+b.c"]
    words = [text(n) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8) for _ in range(4)] + ["", None, "needle", "Needle", "+b.", "absent"]
    assert pairs(spark, texts, words) == wanted(texts, words)


def long_texts():
    rng = random.Random(7)
    letters = "abAB😀ñ\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", None, "aaaaaaaaaaaaaaaaaaaaaaaa", "😀" * 20]
    words = [t[i : i + n] for t in texts if t for n in range(1, 14) for i in [rng.randrange(0, max(len(t) - n, 1))]] + ["aaaaaaa", "AAAAAAAA", "😀" * 7, "", "aaaaaaaaab"]
    return texts, words


def test_pairs_of_all_lengths_come_once(spark):
    """Keywords of every class of length, repeating and beyond the basic plane, at every place of a text."""
    texts, words = long_texts()
    assert pairs(spark, texts, words) == wanted(texts, words)


def test_keywords_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BROADCAST_GRAMS", 0)
    texts, words = long_texts()
    assert pairs(spark, texts, words) == wanted(texts, words)


def test_rows_that_repeat_have_pairs_each(spark):
    texts = spark.createDataFrame([(1, "one needle"), (1, "one needle"), (1, "a needle, two needles")], "text_id int, text string")
    words = spark.createDataFrame([("needle",), ("needle",), ("needles",)], "keyword string")
    assert sorted(map(tuple, keywords.containments(texts, words).collect())) == [(1, "needle")] * 3 + [(1, "needles")]


def test_no_index_of_texts_is_written(spark, monkeypatch):
    """Only what is made from keywords is written, and a text's strings meet it in the task that cuts them."""
    written = []
    monkeypatch.setattr(keywords, "materialize", lambda df, name="table": written.append(df.count()) or session.materialize(df, name))
    texts = spark.createDataFrame([(i, f"the needle number {i}") for i in range(50)], "text_id int, text string")
    found = keywords.containments(texts, spark.createDataFrame([("needles",), ("number 7",)], "keyword string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [(7, "number 7")]
    assert sum(written) <= 6


def test_keywords_are_looked_up_by_what_few_share(spark):
    words = spark.createDataFrame([(f"product-{i:04d}", f"product-{i:04d}") for i in range(1000)], "keyword string, _word string")
    shared = keywords._lookups(words).groupBy("_gram").count()
    assert shared.agg(F.max("count")).first()[0] <= 100
    assert {(r.n, r.k) for r in keywords._lookups(words).groupBy("keyword").agg(F.count("*").alias("n"), F.count_distinct(F.col("_at") % 3).alias("k")).collect()} == {(3, 3)}


def test_of_nothing(spark):
    assert pairs(spark, ["a"], []) == pairs(spark, [], ["a"]) == pairs(spark, [None], [""]) == []


def test_has_no_nested_loop(spark):
    nodes = spark.createDataFrame([("a b", 1), ("a b", 1), (None, 2)], "name string, k int")
    words = spark.createDataFrame([("A",), ("zz",)], "keyword string")
    kept = graph.matching_table(nodes, ["name"], words)
    assert [tuple(r) for r in kept.collect()] == [("a b", 1)] * 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_equal_the_column(spark):
    answers = spark.createDataFrame([(1, "el grado con 240 ects"), (2, None), (3, "nothing"), (4, "TIENE grado ects tiene")], "a int, answer string")
    references = spark.createDataFrame([(7, "Grado tiene 240 ECTS"), (8, "a b c"), (9, None)], "r int, reference string")
    got = {(x.a, x.r): x.overlap for x in evaluation.overlaps(answers, references, "a", "r").collect()}
    pairs = answers.join(references).select("a", "r", evaluation.keyword_overlap(F.col("reference"), F.col("answer")).alias("o")).collect()
    assert got == {(x.a, x.r): x.o or 0.0 for x in pairs} and got[1, 7] == 0.667 and len(got) == 12


def test_overlaps_shuffle_no_pairs(spark):
    """Pairs come last: nothing above the join of answers with references shuffles, sorts or sums up."""
    answers = spark.createDataFrame([(i, "grado ects tiene") for i in range(20)], "a int, answer string")
    references = spark.createDataFrame([(i, "Grado tiene ECTS") for i in range(20)], "r int, reference string")
    got = evaluation.overlaps(answers, references, "a", "r")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Cross")]
    assert "Aggregate" not in above and "Repartition" not in above and plan.count("Join Cross") == 1
    assert {r.overlap for r in got.collect()} == {1.0} and got.count() == 400
