"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own characters say so, in any script, so equal passages give
equal chunks wherever they stand. One pass over the texts writes each document's recipe:
the ordered list of its chunks' identifiers, some dozen bytes a chunk. From then on only recipes and the
chunk dictionary move, never the texts.

An identifier is a 64-bit hash. The dictionary holds every chunk's hash with the SHA-256 of
its content and so shows which hashes name more than one chunk; those hashes get a variant
number that tells their chunks apart, so an identifier always stands for one
verified content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import lower_ascii, text_or_empty
from loomspan.session import materialize

#: A chunk has at least and at most so many characters (the last may be shorter).
LEAST, MOST = 32, 2048
#: Within REACH characters, a chunk ends before characters of the form "xyx.y" with x and y unlike, some one in 250 places
#: of most scripts; in scripts of thousands of characters, also after one whose code point's last nine bits are 0 or 1.
#: Cuts that far apart let the chunks of shifted copies soon fall together.
_LARGE_SCRIPTS = "".join(f"{chr(c)}{chr(c + 1)}" for c in range(0x3400, 0xD7A0, 512))
RARE = rf"(?:(?=(.)(?!\2)(.)\2.\3)|(?<=[\u3400-\uD7A3])(?<=[{_LARGE_SCRIPTS}]))"
#: Where none is in reach, it ends after FURTHER characters or more, after a blank or before "x.x".
REACH, FURTHER = 512, 128
OFTEN = r"(?:(?<=\s)|(?=(.).\4))"


def chunks(text: Column) -> Column:
    """Cut a text into chunks whose concatenation is the text. Where one ends depends on its own characters and few further ones."""
    pattern = rf"(?s)(.{{{LEAST},{REACH}}}?{RARE}|.{{{FURTHER},{MOST}}}?{OFTEN}|.{{1,{MOST}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hash_chunk: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The row with the
    largest id stays; where rows repeat an id, each of them has ``kept`` set. A
    null text counts as empty, a null id stays only if all ids of its group are
    null. A text of any length is read whole. An empty table gives an empty result; other
    columns are ignored, so no names clash. ``hash_chunk`` is a parameter so that tests can
    force collisions.
    """
    base = docs.select(F.col(f"`{id_column}`").alias("doc_id"), lower_ascii(text_or_empty(F.col(f"`{text_column}`"))).alias("_text"))
    entry = F.transform(chunks(F.col("_text")), lambda c: F.struct(hash_chunk(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("digest")))
    listed = materialize(base.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), entry.alias("_chunks")), "recipes")
    dictionary = listed.select(F.explode("_chunks").alias("_c")).select("_c.h", "_c.digest").distinct()
    clashing = materialize(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("h"), "clashing")
    if clashing.isEmpty():
        recipes = listed.select("doc_id", "text_sha256", F.col("_chunks.h").alias("_recipe"))
    else:
        recipes = _with_variants(listed, clashing, dictionary)
    # Groups are written, so that the join below deals out both sides anew and a group of very many rows can be split.
    groups = recipes.groupBy("_recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = materialize(groups.filter("group_size > 1"), "groups")
    return recipes.join(repeated, "_recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _with_variants(listed: DataFrame, clashing: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Recipes in which every hash is followed by its chunk's variant number.

    Only chunks under a clashing hash are numbered; all others are variant 0. Rows that repeat an id
    and a text share one recipe.
    """
    order = Window.partitionBy("h").orderBy("digest")
    variants = dictionary.join(clashing, "h", "left_semi").withColumn("_variant", F.row_number().over(order).cast("long"))
    keyed = listed.withColumn("_row", F.struct("doc_id", "text_sha256"))
    parts = keyed.select("_row", F.posexplode("_chunks").alias("_pos", "_c")).select("_row", "_pos", "_c.*").distinct()
    numbered = (
        parts.join(variants, ["h", "digest"], "left")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "h", F.coalesce("_variant", F.lit(0)).alias("_v")))).alias("_l"))
        .select(F.col("_row").alias("_of"), F.flatten(F.transform("_l", lambda x: F.array(x["h"], x["_v"]))).alias("_recipe"))
    )
    joined = keyed.join(numbered, F.col("_row").eqNullSafe(F.col("_of")), "left")
    return joined.select("doc_id", "text_sha256", F.coalesce("_recipe", F.array().cast("array<long>")).alias("_recipe"))
