"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, a node of its component, for every node of ``links`` (a, b).

    Every round each node points to the least node among itself and its
    neighbours, pointers are followed twice, and links move to the nodes pointed
    to. Links within one node go, so the graph shrinks from round to round until
    none is left; then the roots are the least nodes of their components. Rounds
    are written tables, and a node with very many links is summed up before it
    is shuffled.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = None
    for _ in range(most_rounds):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        point = materialize(ends.groupBy("node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to")), "pointers")
        for _ in range(2):
            next_point = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
            point = point.join(next_point, "to").select("node", F.col("further").alias("to"))
        point = materialize(point, "pointers")
        if roots is None:
            roots = point.select("node", F.col("to").alias("root"))
        else:
            moved = point.select(F.col("node").alias("root"), "to")
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for end in ("a", "b"):
            edges = edges.join(point.select(F.col("node").alias(end), F.col("to").alias(f"_{end}")), end)
        edges = materialize(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return roots
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
