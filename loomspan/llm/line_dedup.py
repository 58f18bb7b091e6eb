"""Line deduplication by the spread of a line over distinct sites.

Each line's sites go into a HyperLogLog sketch, and sketches of a line merge
where they meet, so no task ever holds a line's sites. Lines whose estimate is
near the threshold get an exact distinct count. A line that stands on enough
sites is boilerplate: its first occurrence stays and all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import packed, row_key, text_or_empty
from loomspan.session import materialize

#: Sites from which on a line is boilerplate; estimates within this share of it are counted exactly.
MIN_SITES, NEAR = 8, 0.3
#: Shorter lines, in characters after trimming, are never boilerplate.
MIN_LENGTH = 8
#: Base-2 logarithm of a sketch's registers.
SKETCH_BITS = 9
#: Boilerplate lines up to which their hashes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LINES = 200_000


def _line_key(line: Column) -> Column:
    """128 bits that stand for a trimmed line; equal lines have equal keys."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def _lines(docs: DataFrame, site_column: str, text_column: str) -> DataFrame:
    """One row per line that may be boilerplate: row key, position, line key, site."""
    site = F.col(site_column).cast("string") if site_column in docs.columns else F.lit(None).cast("string")
    split = row_key(docs, text_column=text_column).select(
        F.col("doc_id").alias("_id"), "_k1", "_k2", F.coalesce(site, F.lit("")).alias("_site"),
        F.posexplode(F.split(text_or_empty(text_column), "\n")).alias("_pos", "_line"),
    )
    return split.filter(F.char_length(F.trim("_line")) >= MIN_LENGTH).select(
        "_id", "_k1", "_k2", F.xxhash64("_site").alias("_site"), "_pos", _line_key(F.col("_line")).alias("_key")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of lines on at least ``min_sites`` sites, and where each stands first."""
    spread = materialize(
        lines.groupBy("_key")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(SKETCH_BITS))).alias("_sites"),
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("_k1", "_k2", "_pos")).alias("_first"),
        )
        .filter((F.col("_sites") >= min_sites * (1 - NEAR)) & (F.col("_n") >= min_sites)),
        "spread",
    )
    near = spread.filter(F.col("_sites") <= min_sites * (1 + NEAR))
    exact = (
        lines.select("_key", "_site")
        .join(near.select("_key"), "_key", "left_semi")
        .distinct()
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_exact"))
    )
    return materialize(
        spread.join(exact, "_key", "left")
        .filter(F.coalesce("_exact", "_sites") >= min_sites)
        .select("_key", "_first", F.coalesce("_exact", "_sites").alias("n_sites")),
        "boilerplate",
    )


def remove_boilerplate(
    docs: DataFrame, site_column: str = "source", text_column: str = "text", min_sites: int = MIN_SITES
) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines, ``n_lines`` and ``n_removed``.

    A line counts by its text without surrounding blanks; lines shorter than
    ``MIN_LENGTH`` are left alone. A null site is a site of its own, an absent
    site column makes all rows one site. A null text stays null and has no
    lines; repeated rows are treated alike, so a line that stands first in one
    of them stays in all. ``n_lines`` and ``n_removed`` of the input are replaced. A text of any length is
    read whole. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = _lines(docs, site_column, text_column)
    known = boilerplate(lines, min_sites)
    few = known.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    where = lines.select("_k1", "_k2", "_pos", "_key").join(F.broadcast(known) if few else known, "_key")
    later = where.filter(F.struct("_k1", "_k2", "_pos") != F.col("_first"))
    removed = later.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_all")))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_edges") - 1),
            lambda i: F.slice("_all", F.get("_edges", i - 1) + 2, F.get("_edges", i) - F.get("_edges", i - 1) - 1),
        )
    )
    text = F.col(f"_row.`{text_column}`")
    cut = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return (
        packed(docs, text_column=text_column)
        .join(removed, ["_k1", "_k2"], "left")
        .withColumn("_all", F.split(text, "\n"))
        .withColumn("_edges", F.when(F.col("_gone").isNotNull(), edges))
        .select(
            *[(cut if c == text_column else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns],
            F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        )
    )
