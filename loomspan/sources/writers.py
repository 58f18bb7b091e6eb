"""Sinks: collections that are upserted, logs that are appended, reports and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.evaluation import patch_scores
from loomspan.operators.vector import upsert
from loomspan.session import materialize
from loomspan.sources.snapshots import Snapshots


def upsert_collection(new: DataFrame, path: str, text: str = "text", dry_run: bool = False) -> DataFrame:
    """Upsert rows into a stored collection; of a call's equal texts the first by ``pos`` wins, and the call wins over what was stored.

    The result is a new version of the collection; a failure at any step leaves the old one.
    """
    merged = upsert(new.withColumn("call", F.lit(1)), text).drop("call", "pos")
    if dry_run:
        return merged
    store = Snapshots(new.sparkSession, path)
    began = store.version()
    stored = store.read("rows", merged.schema)
    store.write(rows=stored.join(merged.select("id"), "id", "left_anti").unionByName(merged), after=began)
    return store.read("rows", merged.schema)


def reset_collection(frame: DataFrame, path: str) -> None:
    """Empty a stored collection, keeping its schema."""
    Snapshots(frame.sparkSession, path).reset(rows=frame)


def write_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str) -> int:
    """A graph's nodes by label and its edges as one version, so that no reader sees new nodes with old edges."""
    store = Snapshots(edges.sparkSession, path)
    return store.write(after=store.version(), edges=edges, **{f"nodes_{label}": table for label, table in nodes.items()})


def reset_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str) -> int:
    """Empty a stored graph; all its labels and edges go together."""
    return Snapshots(edges.sparkSession, path).reset(edges=edges, **{f"nodes_{label}": table for label, table in nodes.items()})


def write_back_scores(scores: DataFrame, path: str, replace: bool = False) -> int:
    """Patch stored evaluation results (``results`` of a versioned store) with the judge's scores, as ``patch_scores`` does, as a new version."""
    store = Snapshots(scores.sparkSession, path)
    began = store.version()
    stored = store.read("results", store.schema("results"))
    return store.write(after=began, results=patch_scores(stored, scores, replace))


def with_ids(rows: DataFrame, order: str = "timestamp", last_id: int = 0, name: str = "id") -> DataFrame:
    """Rows with ids that follow ``last_id`` in order of a column.

    Ids are given per range-partition, after a count of the ranges before, so no
    task numbers all rows.
    """
    ranged = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_i", F.monotonically_increasing_id()), "log").withColumn("_p", F.shiftright("_i", 33))
    ranges = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranges.select("_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + last_id + 1 - F.col("_low")).alias("_start"))
    return ranged.join(starts, "_p").withColumn(name, F.col("_i") + F.col("_start")).drop("_p", "_i", "_start")


def append_log(rows: DataFrame, path: str, last_id: int = 0) -> DataFrame:
    """Append rows with ids that follow ``last_id`` in order of time."""
    out = with_ids(rows, "timestamp", last_id)
    out.write.mode("append").parquet(path)
    return out


def write_report(report: DataFrame, path: str) -> None:
    """A report of nested columns as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, name: str = "name", text: str = "text", dry_run: bool = False) -> DataFrame:
    """Texts under their names, one folder per name; how many there are and their characters. ``dry_run`` only counts."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars"))
    if dry_run:
        return counts
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
    return counts
