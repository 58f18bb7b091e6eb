"""Times as text, and what has passed between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_format(at: Column) -> Column:
    """A time as ISO 8601 without zone; microseconds, all six digits, only where there are any."""
    seconds, micros = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def shown_time(at: Column) -> Column:
    """A time to the second, as a report shows it."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def stamp(at: Column) -> Column:
    """A time for a file's name."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def elapsed(start: Column, end: Column, digits: int = 2) -> Column:
    """Seconds from ``start`` to ``end``."""
    micros = lambda at: F.unix_micros(at.cast("timestamp"))
    return F.round((micros(end) - micros(start)) / 1e6, digits)
