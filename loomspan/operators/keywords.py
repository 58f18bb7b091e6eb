"""Which texts contain which keywords, both as tables: an index of grams cut at steps, then verification.

A text is cut into strings of ``gram`` characters at every ``step``-th position. Of ``step`` strings at places of a keyword that follow each
other, one lies at such a position wherever the keyword stands, so a keyword is looked up by those of its strings that the fewest keywords share,
by an equality join, and only the texts found there are searched for it. Texts are read once and, where the keywords can be broadcast,
nothing that is made from them is written or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import materialize

#: By the fewest characters of a keyword: characters of a gram, and of a step. The fewest are ``gram + step - 1``.
CUTS = ((7, 5, 3), (5, 4, 2), (4, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1), (0, 0, 1))
#: Grams of keywords that are broadcast at most.
BROADCAST_GRAMS = 300_000


def _grams(text: Column, size: int, step: int = 1) -> Column:
    """Strings of ``size`` characters at every ``step``-th place, in order; one empty string for size 0."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}})).{{{step}}}"), F.lit(1)) if size else F.array(F.lit(""))


def _lookups(words: DataFrame) -> DataFrame:
    """The grams (``_gram``) that each keyword is looked up by, with their place (``_at``) in it and the step at which texts are cut."""
    cut = F.lit(None).cast("struct<size:int,step:int,grams:array<string>>")
    for least, size, step in reversed(CUTS):
        cut = F.when(F.char_length("_word") >= least, F.struct(F.lit(size).alias("size"), F.lit(step).alias("step"), _grams(F.col("_word"), size).alias("grams"))).otherwise(cut)
    placed = words.withColumn("_cut", cut).select("keyword", "_word", F.col("_cut.size").alias("_size"), F.col("_cut.step").alias("_step"), F.posexplode("_cut.grams").alias("_at", "_gram"))
    shared = placed.join(placed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")), "_gram")
    # A word's grams are as many as its characters.
    listed = shared.groupBy("keyword", "_word", "_size", "_step").agg(F.array_sort(F.collect_list(F.struct("_at", "_gram", "_n"))).alias("_grams"))
    most = lambda i: F.array_max(F.transform(F.slice("_grams", i, F.col("_step")), lambda g: g["_n"]))
    first = F.array_min(F.transform(F.sequence(F.lit(1), F.size("_grams") - F.col("_step") + 1), lambda i: F.struct(most(i).alias("n"), i.alias("i"))))["i"]
    return listed.withColumn("_first", first).select("keyword", "_word", "_size", "_step", F.explode(F.slice("_grams", F.col("_first"), F.col("_step"))).alias("_g")).select("keyword", "_word", "_size", "_step", "_g._at", "_g._gram")


def containments(texts: DataFrame, keywords: DataFrame, text_id: str = "text_id", text: str = "text", keyword: str = "keyword") -> DataFrame:
    """Pairs (``text_id``, ``keyword``) of texts that contain a keyword, whatever the case of either: for each row of ``texts`` one per distinct keyword.

    Null texts and keywords contain and are in nothing; an empty keyword is in every text.
    """
    low = texts.select(F.col(text_id).alias("text_id"), F.lower(F.col(text)).alias("_text")).filter("_text IS NOT NULL")
    words = keywords.select(F.col(keyword).alias("keyword"), F.lower(F.col(keyword)).alias("_word")).filter("_word IS NOT NULL").distinct()
    lookups = materialize(_lookups(words), "lookups")
    # Texts are cut only as the keywords need it.
    cuts = lookups.groupBy("_size", "_step").agg(F.count(F.lit(1)).alias("n")).collect()
    lookups = lookups.drop("_size")
    if not cuts:
        return low.select("text_id", F.lit(None).cast("string").alias("keyword")).limit(0)
    gram = F.explode(F.array_distinct(F.concat(*[_grams(F.col("_text"), c["_size"], c["_step"]) for c in sorted(cuts)]))).alias("_gram")
    # The place where a word stands first decides by which one of its grams it counts as found, so no pair comes twice.
    there = F.contains("_text", F.col("_word")) & ((F.instr("_text", F.col("_word")) - 1 + F.col("_at")) % F.col("_step") == 0)
    # Few files can hold many texts, and a text is more work than bytes, so texts are dealt to all tasks.
    dealt = low.repartition(int(low.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_id", "_text")
    if sum(c["n"] for c in cuts) <= BROADCAST_GRAMS:
        found = dealt.select("text_id", "_text", gram).join(F.broadcast(lookups), "_gram")
    else:  # grams and what they find are shuffled without the texts
        rows = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), "texts")
        found = rows.select("_row", gram).join(lookups, "_gram").drop("_gram").join(rows, "_row")
    return found.filter(there).select("text_id", "keyword")
