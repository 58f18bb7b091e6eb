"""Places of rows within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import materialize


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Add ``name``, a row's place (from 0) in its group by ``order``, nulls first.

    Rows are dealt out by ranges of group and order, so a group of any size lies
    in as many ranges as it needs; a row's place is that in its range and the
    number of the group's rows in earlier ranges. Columns of ``group`` must not be
    null. Rows that are equal in ``order`` come in any order.
    """
    by = [*group, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(ranged, "ranged").withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).drop("_from", "_n")
    return placed.join(starts, [*group, "_range"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_range", "_start")
