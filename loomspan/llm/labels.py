"""Labelled rows for training: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row's label is kept for testing: crc32 of its id as text, modulo ``modulus``."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, at_most: int
) -> DataFrame:
    """``text`` and ``label`` of at most ``at_most`` labelled rows, none of them held out.

    The sample is those of least hash of their id, so it doesn't depend on order
    or partitions. Null ids, labels and texts are left out, as is a label given
    twice with different values.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .filter(~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_other"))
        .filter(F.col("label") == F.col("_other"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(at_most)
        .select("doc_id", "label")
    )
    # The right side has at most ``at_most`` rows of two numbers.
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(usable), "doc_id").select("text", F.col("label").cast("int").alias("label"))
