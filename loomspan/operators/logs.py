"""Analytics over an interaction log, and configuration kept as keys and values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.strings import shorten


def log_filter(intent: str | None = None, feedback: str | None = None, is_safe: bool | None = None) -> Column:
    """All filters that are given, joined by and. An empty intent is none; ``feedback`` is
    "1", "0" or "none" (no answer), and any other value filters nothing."""
    parts: list[Column] = [F.lit(True)]
    if intent:
        parts.append(F.col("intent") == intent)
    if feedback in ("0", "1"):
        parts.append(F.col("feedback") == int(feedback))
    elif feedback == "none":
        parts.append(F.col("feedback").isNull())
    if is_safe is not None:
        parts.append(F.col("is_safe") == is_safe)
    return reduce(and_, parts)


def log_page(log: DataFrame, page: int = 1, page_size: int = 10, where: Column | None = None) -> DataFrame:
    """One page of the log, newest first, ties by id; pages below 1 are page 1."""
    rows = log if where is None else log.filter(where)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).offset((max(1, page) - 1) * page_size).limit(page_size)


def page_count(log: DataFrame, page_size: int = 10, where: Column | None = None) -> DataFrame:
    """How many rows and pages there are; at least one page."""
    rows = log if where is None else log.filter(where)
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long").alias("total_pages"))


def page_object(log: DataFrame, page: int = 1, page_size: int = 10, where: Column | None = None) -> DataFrame:
    """One row: the page's ``items`` in order, ``total``, ``page``, ``page_size``, ``total_pages``, and the first and last row's number (0 if none)."""
    number = max(1, page)
    rows = log_page(log, number, page_size, where).withColumn("rerank_score", F.round("rerank_score", 3))
    # A page's rows are at most ``page_size``.
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("timestamp", "id", *[c for c in log.columns if c not in ("timestamp", "id")]))))
    first = F.lit((number - 1) * page_size)
    return rows.agg(newest.alias("items")).crossJoin(page_count(log, page_size, where)).select(
        "items",
        "total",
        F.lit(number).cast("long").alias("page"),
        F.lit(page_size).cast("long").alias("page_size"),
        "total_pages",
        F.when(F.size("items") > 0, first + 1).otherwise(0).cast("long").alias("from_row"),
        F.when(F.size("items") > 0, first + F.size("items")).otherwise(0).cast("long").alias("to_row"),
    )


def feedback_percent(average: Column) -> Column:
    """Mean feedback as it is shown: a whole percentage, a dash where there is none."""
    return F.when(average.isNull(), "—").otherwise(F.concat(F.floor(average * 100 + 0.5).cast("string"), F.lit("%")))


def log_stats(log: DataFrame) -> DataFrame:
    """Totals, mean feedback and the share of safe questions, in one pass; sums of nothing are 0."""
    total, safe = F.count(F.lit(1)), F.count_if(F.coalesce("is_safe", F.lit(False)))
    return log.agg(
        total.alias("total_interactions"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("total_tokens"),
        F.avg("feedback").alias("avg_feedback"),
        F.when(total == 0, 0.0).otherwise(F.round(safe / total * 100, 1)).alias("safe_pct"),
    )


def intent_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def apply_feedback(log: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with each row's latest feedback, and the updates rejected.

    ``updates`` has id, score and ``seq``. Scores other than 0 and 1 and ids that
    the log lacks are rejected.
    """
    valid = F.col("score").isin(0, 1)
    latest = updates.filter(valid).groupBy("id").agg(F.max_by("score", "seq").alias("_score"))
    updated = log.join(latest, "id", "left").withColumn("feedback", F.coalesce("_score", "feedback")).drop("_score")
    unknown = updates.filter(valid).join(log.select("id"), "id", "left_anti")
    return updated, unknown.unionByName(updates.filter(~F.coalesce(valid, F.lit(False))))


def latest_config(writes: DataFrame) -> DataFrame:
    """The last value written per key; a null value writes nothing."""
    return writes.filter(F.col("value").isNotNull()).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def effective_config(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults, overlaid by stored values that aren't empty."""
    over = stored.select("key", F.nullif("value", F.lit("")).alias("_value"))
    return defaults.join(over, "key", "left").select("key", F.coalesce("_value", "value").alias("value"))


def exploded_rows(log: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Two rows per interaction for display: its question, then its answer."""
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("question").alias("kind"), shorten(F.col(question)).alias("shown")),
        F.struct(F.lit(1).alias("part"), F.lit("answer").alias("kind"), shorten(F.col(answer)).alias("shown")),
    )
    return log.select("id", F.explode(parts).alias("_p")).select("id", "_p.*")


def page_window(page: Column, total_pages: Column, around: int = 2) -> Column:
    """Page numbers to show: the first, the last, and those around the page; 0 stands for a gap."""
    low, high = F.greatest(F.lit(1), page - around), F.least(total_pages, page + around)
    empty = F.array().cast("array<long>")
    first = F.when(low > 2, F.array(F.lit(1), F.lit(0))).when(low == 2, F.array(F.lit(1))).otherwise(empty)
    last = F.when(high < total_pages - 1, F.array(F.lit(0).cast("long"), total_pages)).when(high == total_pages - 1, F.array(total_pages)).otherwise(empty)
    return F.concat(first.cast("array<long>"), F.sequence(low, high).cast("array<long>"), last.cast("array<long>"))


def source_kind(url: Column) -> Column:
    """What a source is shown as: a PDF, a web page or nothing to open."""
    return F.when(url.isNull() | (url == ""), "none").when(F.endswith(F.lower(url), F.lit(".pdf")), "pdf").otherwise("web")


def over_limit(requests: DataFrame, most: int, window: str = "1 minute", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Requests per key and fixed window, and whether they exceed the limit."""
    counted = requests.groupBy(key, F.window(at, window).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("_w.start").alias("window_start"), "n", (F.col("n") > most).alias("limited"))


def by_id(log: DataFrame, log_id: int) -> DataFrame:
    """The interaction of an id, or none."""
    return log.filter(F.col("id") == log_id)
