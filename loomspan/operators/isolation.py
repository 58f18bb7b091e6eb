"""Python steps of which one row's failure leaves the others: values and errors side by side, then two tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import bound_batches

#: Characters of an error's message that are kept.
LONGEST_ERROR = 500


def isolated(run: Callable[[Any], Any], kind: str) -> Callable[[Column], Column]:
    """A column function that gives a struct of ``value`` (of type ``kind``) and ``error``, of which one is null.

    Whatever exception ``run`` raises for a row is that row's error, as its type and message; a null is given to ``run`` as None. The
    column is one of text or bytes; numbers should come as text, since a batch of whole numbers with nulls would reach ``run`` as fractions.
    Batches are of few rows, so a worker's memory doesn't grow with the rows.
    """

    def one(value: Any) -> tuple[Any, str | None]:
        try:
            return run(None if value is None or value is pd.NA else value), None
        except Exception as error:  # a row's failure is its result
            return None, f"{type(error).__name__}: {error}"[:LONGEST_ERROR]

    def batch(values: pd.Series) -> pd.DataFrame:
        done = [one(v) for v in values]
        return pd.DataFrame({"value": pd.Series([v for v, _ in done], dtype=object), "error": pd.Series([e for _, e in done], dtype=object)})

    def applied(column: Column) -> Column:
        bound_batches(SparkSession.active())
        return F.pandas_udf(batch, f"struct<value:{kind},error:string>")(column)

    return applied


def good_rows(results: DataFrame, error: str = "error") -> DataFrame:
    """The rows without an error."""
    return results.filter(F.col(error).isNull()).drop(error)


def dead_letters(results: DataFrame, *keys: str, error: str = "error") -> DataFrame:
    """The rows with an error: their keys, the error's class and its message."""
    failed = results.filter(F.col(error).isNotNull())
    return failed.select(*keys, F.regexp_extract(error, r"^([^:]*)", 1).alias("error_class"), F.regexp_extract(error, r"(?s)^[^:]*: ?(.*)$", 1).alias("message"))


def failure_counts(results: DataFrame, error: str = "error") -> DataFrame:
    """Rows by class of error, null for those without."""
    kind = F.when(F.col(error).isNotNull(), F.regexp_extract(error, r"^([^:]*)", 1))
    return results.groupBy(kind.alias("error_class")).agg(F.count(F.lit(1)).alias("n"))
