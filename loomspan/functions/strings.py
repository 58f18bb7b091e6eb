"""String expressions with Unicode white space, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def strip(c: Column) -> Column:
    """Without white space at either end; ``trim`` would take blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_words(c: Column) -> Column:
    """Words between runs of white space."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    parts = F.split(c, LINE_ENDS)
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_given(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether any of an array's keywords is in the text, whatever their case; false for nulls."""
    return F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k))), F.lit(False))


def contained(text: Column, hints: list[str]) -> Column:
    """The hints, in their order, that the lower-cased text contains."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(h)), F.lit(h)) for h in hints]))


def shorten(c: Column, most: int = 120) -> Column:
    """Without Markdown emphasis, cut with an ellipsis beyond ``most`` characters; a dash for null."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1"), "`", "")
    cut = F.when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)
    return F.coalesce(cut, F.lit("—"))


def text_bar(value: Column, width: int = 20) -> Column:
    """A bar of ``width`` blocks, filled in proportion to a value from 0 to 1."""
    full = F.round(value * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
