"""Answer-quality evaluation: heuristics, summaries, and comparison of two systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.strings import split_words
from loomspan.operators.keywords import containments
from loomspan.session import materialize

#: Scores below and above which a question counts as a critical success.
PLAIN_BELOW, GRAPH_ABOVE = 0.3, 0.8
#: Words of all references, and references, that are broadcast at most.
BROADCAST_WORDS = 1_000_000
#: The label of the row over all categories.
ALL = "__global__"


def keyword_overlap(reference: Column, answer: Column, least: int = 4) -> Column:
    """The share of the reference's words, of ``least`` letters or more, that the answer contains."""
    words = F.array_distinct(F.transform(F.filter(split_words(reference), lambda w: F.char_length(w) >= least), F.lower))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(answer), w)))
    return F.when(F.size(words) > 0, F.round(hits / F.size(words), 3)).otherwise(F.lit(0.0))


def overlaps(answers: DataFrame, references: DataFrame, answer_key: str, reference_key: str, answer: str = "answer", reference: str = "reference", least: int = 4) -> DataFrame:
    """``keyword_overlap`` of each answer of a stated set with each reference: both keys, which are unique, and ``overlap``.

    Each distinct word is looked up once in the answers' index. An answer then has the numbers of the words found in it, a reference
    those of its words, and a pair counts what both have: pairs are never shuffled, sorted or summed up, so a task holds one answer at a time.
    """
    words = F.array_distinct(F.transform(F.filter(split_words(F.col(reference)), lambda w: F.char_length(w) >= least), F.lower))
    of_words = references.select(F.col(reference_key).alias("_r"), F.explode(words).alias("keyword"))
    numbered = materialize(of_words.select("keyword").distinct().withColumn("_w", F.monotonically_increasing_id()), "words")
    found = containments(answers, numbered, answer_key, answer).join(numbered, "keyword")
    found = found.groupBy(F.col("text_id").alias("_a")).agg(F.collect_list("_w").alias("_found"))
    sets = of_words.join(numbered, "keyword").groupBy("_r").agg(F.collect_list("_w").alias("_words"))
    none = F.array().cast("array<bigint>")
    sets = materialize(references.select(F.col(reference_key).alias("_r")).join(sets, "_r", "left").select("_r", F.coalesce("_words", none).alias("_words")), "references")
    small = (sets.agg(F.sum(F.size("_words") + 1)).first()[0] or 0) <= BROADCAST_WORDS
    # Answers are few bytes that make many pairs, so tasks must not be joined by bytes.
    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = answers.select(F.col(answer_key).alias("_a")).join(found, "_a", "left").select("_a", F.coalesce("_found", none).alias("_found")).repartition(tasks, "_a")
    pairs = dealt.crossJoin(F.broadcast(sets) if small else sets)
    n = F.size("_words")
    share = F.when(n > 0, F.round(F.size(F.array_intersect("_found", "_words")) / n, 3)).otherwise(F.lit(0.0))
    return pairs.select(F.col("_a").alias(answer_key), F.col("_r").alias(reference_key), share.alias("overlap"))


def no_context(answer: Column, signal: str) -> Column:
    return F.contains(F.lower(answer), F.lit(signal.lower()))


def answer_length(answer: Column) -> Column:
    return F.size(split_words(answer)).cast("long")


def run_summary(results: DataFrame) -> DataFrame:
    """Counts and rates over results with ``answer``, ``error``, ``no_context`` and ``overlap``."""
    total, ok = F.count(F.lit(1)), F.col("error").isNull()
    answered = ok & ~F.coalesce("no_context", F.lit(False))
    return results.agg(
        total.alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(ok & F.coalesce("no_context", F.lit(False))).alias("no_context"),
        F.count_if(answered).alias("answered"),
        F.count_if(~ok).alias("errors"),
        F.round(F.try_divide(F.count_if(answered), total), 3).alias("answered_rate"),
        F.round(F.try_divide(F.count_if(ok & F.coalesce("no_context", F.lit(False))), total), 3).alias("no_context_rate"),
        F.coalesce(F.round(F.avg(F.when(answered, F.col("overlap"))), 3), F.lit(0.0)).alias("avg_overlap"),
    )


def by_category(results: DataFrame) -> DataFrame:
    """Mean overlap per category over all results that have one."""
    return results.groupBy("category").agg(F.count("overlap").alias("n"), F.round(F.avg("overlap"), 3).alias("avg_overlap")).orderBy("category")


def score_stats(items: DataFrame, scores: tuple[str, ...] = ("faithfulness", "correctness")) -> DataFrame:
    """Means per category and over all; ``n`` counts all rows, ``n_scored`` those with the first score."""
    clean = items.select("category", *[F.when(~F.isnan(F.col(s)), F.col(s)).alias(s) for s in scores])
    grouped = clean.groupingSets([["category"], []], "category").agg(
        F.grouping("category").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count(scores[0]).alias("n_scored"),
        *[F.round(F.avg(s), 4).alias(f"avg_{s}") for s in scores],
    )
    return grouped.withColumn("category", F.when(F.col("_all") == 1, ALL).otherwise(F.col("category"))).drop("_all")


def improvement(plain: Column, graph: Column, digits: int = 2) -> Column:
    """The percentage by which ``graph`` exceeds ``plain``; null where it can't be told."""
    return F.when(plain != 0, F.round((graph - plain) / plain * 100, digits))


def comparison(categories: DataFrame, plain: DataFrame, graph: DataFrame, scores: tuple[str, ...] = ("faithfulness", "correctness")) -> DataFrame:
    """Both systems' means side by side, a row per category and score; absent categories have nulls."""
    a = plain.select("category", *[F.col(f"avg_{s}").alias(f"_p_{s}") for s in scores])
    b = graph.select("category", *[F.col(f"avg_{s}").alias(f"_g_{s}") for s in scores])
    wide = categories.select("category").join(a, "category", "left").join(b, "category", "left")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"_p_{s}").alias("plain"), F.col(f"_g_{s}").alias("graph")) for s in scores]))
    return wide.select("category", rows.alias("_r")).select("category", "_r.*").withColumn("improvement_pct", improvement(F.col("plain"), F.col("graph")))


def error_class(status: Column, message: Column) -> Column:
    """What went wrong with a request as a struct: ``error`` (null if nothing did) and whether its latency still counts.

    No status and no message: the server wasn't reached; a status from 400 on is named by its code;
    any other message stands for itself, and such a result has no metrics at all.
    """
    refused = status.isNull() & message.isNull()
    error = F.when(refused, "ConnectionError").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(message)
    return F.struct(error.alias("error"), (refused | (F.coalesce(status, F.lit(0)) >= 400) | error.isNull()).alias("has_latency"))


def last_by_id(results: DataFrame, order: str = "pos") -> DataFrame:
    """One row per id, the last in order."""
    return results.groupBy("id").agg(F.max_by(F.struct(*results.columns), order).alias("_r")).select("_r.*")


def critical_successes(plain: DataFrame, graph: DataFrame, score: str = "correctness") -> DataFrame:
    """Questions that the plain system fails and the other answers, by improvement. Of repeated ids the last counts, by ``pos``, or as read where there is none."""
    a, b = (last_by_id(x if "pos" in x.columns else x.withColumn("pos", F.monotonically_increasing_id())) for x in (plain, graph))
    a, b = a.select("id", F.col(score).alias("plain")), b.select("id", F.col(score).alias("graph"))
    kept = a.join(b, "id").filter((F.col("plain") < PLAIN_BELOW) & (F.col("graph") > GRAPH_ABOVE))
    return kept.withColumn("improvement", F.round(F.col("graph") - F.col("plain"), 4)).orderBy(F.desc("improvement"), "id")


def top_and_bottom(items: DataFrame, score: str = "correctness", n: int = 5, key: str = "id") -> DataFrame:
    """The n best and the n worst by score; a row may be both where there are few."""
    scored = items.filter(F.col(score).isNotNull())
    best = scored.orderBy(F.desc(score), key).limit(n).withColumn("list", F.lit("top"))
    worst = scored.orderBy(F.asc(score), F.desc(key)).limit(n).withColumn("list", F.lit("bottom"))
    return best.unionByName(worst)


def judge_samples(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results that can be judged, and the others with the reason."""
    reason = F.when(F.col("error").isNotNull(), "error").when(F.col("answer").isNull(), "no answer")
    marked = results.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def zip_scores(items: DataFrame, scores: DataFrame, order: str = "pos") -> DataFrame:
    """The n-th item that can be judged gets the n-th score; items beyond the scores get null.

    Places are numbered within one evaluation run, which is a list that was
    judged in sequence and so is small.
    """
    numbered = items.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy(order)))
    given = scores.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy(order))).drop(order)
    return numbered.join(given, ["run", "_n"], "left").drop("_n")


def patch_scores(results: DataFrame, scores: DataFrame, replace: bool = False) -> DataFrame:
    """Results with the judge's two scores set in their ``ragas`` struct, where the id matches.

    ``replace`` writes the whole struct, its other two fields null.
    """
    new = scores.select("id", F.col("faithfulness").alias("_f"), F.col("correctness").alias("_c"), F.lit(True).alias("_has"))
    kept = F.col("ragas")
    if replace:
        none = F.lit(None).cast("double")
        changed = F.struct(F.col("_f").alias("faithfulness"), F.col("_c").alias("answer_relevancy"), none.alias("context_recall"), none.alias("context_precision"))
    else:
        changed = kept.withField("faithfulness", F.col("_f")).withField("answer_relevancy", F.col("_c"))
    return results.join(new, "id", "left").withColumn("ragas", F.when(F.col("_has"), changed).otherwise(kept)).drop("_f", "_c", "_has")
