"""Quality rules: plain counts of a text, and how much its words are those of trusted texts.

Words and pairs of words are hashed to a fixed number of bins. Two multinomials over the bins, of
trusted texts and of all texts, are estimated by sums that combine before they are
shuffled. A document's score is the mean over its words and pairs of the logarithm of the two
probabilities' ratio, and documents below a fixed threshold go. All of it is
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_or_empty

#: What parts words, and which characters are symbols.
BLANKS, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
#: A document of fewer words fails, as does one whose repeated windows hold over half its words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 0.5, 3
#: Bins of the multinomials; the table of their ratios is all that the driver sees.
BINS = 1 << 14
#: Rows of 64 bits, at most, of the table that tells which documents may be trusted.
SET_ROWS = 1 << 17
#: Count that is added to each bin, spread by the other multinomial.
PRIOR = 0.5
#: Mean log-ratio (natural) from which a document stays.
THRESHOLD = -0.1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row however often it is used: functions of arrays would otherwise
    take it in, and compute it anew for every element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _blanked(text: Column) -> Column:
    """A text whose blanks are all the same one, which makes it quick to part."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(BLANKS[0]))
    return text


def _hashed(df: DataFrame, whole: Column) -> DataFrame:
    """Add ``_parts`` (what single blanks part), ``_hashes`` of the words, and ``_pairs`` of adjacent words, in order."""
    df = _once(df, "_parts", F.split(_blanked(whole), BLANKS[0]))
    df = _once(df, "_hashes", F.transform(F.array_remove("_parts", ""), lambda w: F.xxhash64(w)))
    pairs = F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1)))
    return _once(df, "_pairs", F.slice(pairs, F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0))))


def _after(array: str, by: int) -> Column:
    """An array's elements from place ``by`` on (from 0)."""
    return F.slice(F.col(array), F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def _places(placed: str) -> Column:
    """Sorted places of the windows that are found twice or more, from the sorted (window, place)."""
    ends = F.zip_with(placed, _after(placed, 1), lambda x, y: F.when(x["w"] == y["w"], F.array(x["at"], y["at"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(ends, lambda z: z.isNotNull()))))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_hashes`` and ``_pairs`` (of the words), ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Windows are told apart by 64-bit hashes of their words. Within a text the work is that of
    sorting its windows, whatever its length, and most texts repeat none and need no sorting.
    """
    whole = text_or_empty(text)
    df = _hashed(docs, whole)
    df = _once(df, "_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _once(df, "_windows", F.zip_with(_after("_hashes", 2), F.slice("_pairs", F.lit(1), F.greatest(F.size("_pairs") - 1, F.lit(0))), lambda h, p: F.xxhash64(p, h)))
    alike = F.size(F.array_distinct("_windows")) < F.size("_windows")
    listed = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    df = _once(df, "_placed", F.sort_array(F.when(alike, listed).otherwise(F.array().cast("array<struct<w:bigint,at:int>>"))))
    df = _once(df, "_places", _places("_placed"))
    gaps = F.zip_with("_places", _after("_places", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    plain = whole
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    return df.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "word_chars": (F.char_length(whole) - F.size("_parts") + 1).cast("long"),
            "n_symbols": (F.octet_length(whole) - F.octet_length(plain)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x),
        }
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(MOST_REPEATED * 100)))


def _bin(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BINS - 1))


def trusted_ids(labels: DataFrame, at_most: int | None = None) -> DataFrame:
    """Ids of all documents labelled good, or on demand ``at_most`` of them by hash of their id; an id with another label beside it, or null, is left out."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1")
    return good.select("doc_id") if at_most is None else good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most).select("doc_id")


def _that_may_be(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``text`` of the documents whose id is among ``ids``, with few others brought near them.

    A table of the ids as bits, of ``SET_ROWS`` rows of 64 at most however many ids there are, is broadcast and keeps the other
    documents' texts out of the join that decides. That join moves the trusted documents' texts, and others only as the bits fill up.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SET_ROWS * 64))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    placed = ids.filter("doc_id IS NOT NULL").select("doc_id", place.alias("_place"))
    bits = placed.groupBy(F.floor(F.col("_place") / 64).alias("_row")).agg(F.bit_or(bit).alias("_bits"))
    near = docs.select("doc_id", "text", place.alias("_place"))
    near = near.withColumn("_row", F.floor(F.col("_place") / 64)).join(F.broadcast(bits), "_row").filter(F.col("_bits").bitwiseAND(bit) != 0)
    # Not a semi-join, which Spark would move below the broadcast one, where all texts are shuffled for it.
    return near.select("doc_id", "text").join(placed.select("doc_id").distinct(), "doc_id").select("text")


def _counts(texts: DataFrame) -> list[int]:
    """How many words and pairs of words of the texts fall into each bin."""
    hashed = _hashed(texts.select("text"), text_or_empty("text"))
    bins = hashed.select(F.explode(F.concat("_hashes", "_pairs")).alias("_h")).select(_bin(F.col("_h")).alias("bin"))
    counts = [0] * BINS
    for row in bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["bin"]] = row["n"]
    return counts


def fit(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """For each bin, the logarithm of its probability in trusted texts over that in all texts.

    ``trusted`` holds ids, however many. All texts are counted where they lie, whole; those of trusted ids are counted once more,
    and only they, and few others, are moved for that. Without trusted texts, or without any text, all ratios are 0.
    """
    return _ratios(_counts(docs), _counts(_that_may_be(docs, trusted)))


def _ratios(raw: list[int], good: list[int]) -> list[float]:
    """Log-ratios of two smoothed multinomials; each bin gets ``PRIOR`` counts in both."""
    if not sum(good):
        return [0.0] * len(raw)
    all_raw, all_good = sum(raw) + PRIOR * len(raw), sum(good) + PRIOR * len(raw)
    # Few trusted texts say little of a rare bin: their counts get the raw share of PRIOR counts a bin.
    share = [(n + PRIOR) / all_raw for n in raw]
    return [math.log((g + PRIOR * len(raw) * p) / all_good / p) for g, p in zip(good, share, strict=True)]


def rules(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    A text that fails the base rules goes, as does one whose score is below the threshold. A text without words has
    score 0 and fails. A null text has no words; null and repeated ids are rows as any; an empty table gives
    an empty result; other columns are ignored, so no names clash. A text of any length is read whole.
    """
    counted = with_counts(docs.select("doc_id", "text"))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(F.concat("_hashes", "_pairs"), F.lit(0.0), lambda s, h: s + F.get(table, _bin(h).cast("int")))
    scored = counted.withColumn("score", F.coalesce(total / F.nullif(F.col("n_words") * 2 - 1, F.lit(-1)), F.lit(0.0)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    return scored.select(*names, (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
