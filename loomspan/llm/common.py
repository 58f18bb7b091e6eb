"""Text helpers that several of the corpus operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.session import bound_batches

#: What separates words, in a lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does just that to a pure ASCII text and is several times faster
    than ``translate``, so only texts with other characters take the slow way.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(lowered: Column) -> Column:
    """The words of a lower-cased text, in order."""
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def row_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``_k1`` and ``_k2``, which name a row by its id and text.

    Ids may be null or repeated. Rows with equal keys are copies of each other,
    get equal results, and so need no telling apart.
    """
    return df.withColumns(
        {
            "_k1": F.coalesce(F.col(id_column).try_cast("long"), F.lit(-(2**63))),
            "_k2": F.xxhash64(F.col(id_column), F.col(text_column)),
        }
    )


def packed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Whole rows in one column ``_row`` beside their key, so that no name of theirs can clash."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    a, b = F.col(f"_row.`{id_column}`"), F.col(f"_row.`{text_column}`")
    return keyed.withColumns(
        {"_k1": F.coalesce(a.try_cast("long"), F.lit(-(2**63))), "_k2": F.xxhash64(a, b)}
    )


#: Maps every separator to a blank and A-Z to a-z; bytes of other characters stay.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text in Python, as UTF-8: lower-cased A-Z, split at separators."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches that are small although rows hold whole texts, as ``session.bound_batches`` makes them."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
