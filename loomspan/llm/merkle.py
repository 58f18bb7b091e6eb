"""A Merkle manifest of a table, with a proof of every row against one root.

Rows are leaves, in runs of three, per source and then over the sources. The leaves are
numbered within their source by ranges, and consecutive 3^``LEVELS`` of them make a
superblock. Superblocks are reduced to their tops by groups, tops again, until each source
has one, and the sources' tops likewise. Then siblings go the other way: superblocks of
nodes are cogrouped with the outer siblings that their top needs, which finishes local
reduction, proofs and folding in one pass. No group has more than some thousand nodes, and none of a
tree's size is ever in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.numbering import numbered
from loomspan.session import materialize

#: Nodes that are hashed together, and levels of a superblock.
ARITY, LEVELS = 3, 6
#: Trees of one superblock at most are put together by so many in one group.
SMALL_TREES = 27
#: The columns that a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree long, place long, size long, hash string"
_OUTER = "tree long, place long, size long, lefts array<string>, rights array<string>, subroot string"


def leaf_hash(**values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    parts = []
    for name in FIELDS:
        text = values[name].cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def node_hash(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def levels_left(size: int, most: int = LEVELS) -> int:
    """Levels by which ``size`` nodes become one, a superblock's at most."""
    n = 0
    while size > 1 and n < most:
        size, n = -(-size // ARITY), n + 1
    return n


def reduced(hashes: list[str], size: int, most: int = LEVELS) -> list[list[str]]:
    """The levels of one superblock of a tree of ``size`` nodes, from its nodes to its top."""
    rows = [hashes]
    for _ in range(levels_left(size, most)):
        now = rows[-1]
        rows.append([node_hash(now[i : i + ARITY]) for i in range(0, len(now), ARITY)])
    return rows


def siblings(rows: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Hashes to the left and right of node ``i`` in its run, joined, level by level up to the top."""
    lefts, rights = [], []
    for row in rows[:-1]:
        run = i - i % ARITY
        lefts.append("".join(row[run:i]))
        rights.append("".join(row[i + 1 : run + ARITY]))
        i //= ARITY
    return lefts, rights


def folded(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights, strict=True):
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _small(tree: Column) -> Column:
    """The group of a tree of one superblock; groups of larger trees are not negative."""
    return -1 - F.floor(tree / SMALL_TREES)


def _superblock(df: DataFrame, levels: int) -> DataFrame:
    """Add the group (_g1, _g2) of a node: its tree and superblock, or some small trees together."""
    span = ARITY**levels
    group = F.when(F.col("size") <= span, _small(F.col("tree"))).otherwise(F.col("tree"))
    return df.withColumns({"_g1": group, "_g2": F.expr(f"place div {span}")})


def _blocks_of(nodes: pd.DataFrame, levels: int):
    """The superblocks of a group: (tree, number, size, nodes sorted by place)."""
    for (tree, block), part in nodes.assign(_b=nodes["place"] // ARITY**levels).groupby(["tree", "_b"], sort=True):
        yield int(tree), int(block), int(part["size"].iloc[0]), part.sort_values("place")


def _tops(nodes: pd.DataFrame, levels: int) -> pd.DataFrame:
    made = [(tree, block, -(-size // ARITY**levels), reduced(list(part["hash"]), size, levels)[-1][0]) for tree, block, size, part in _blocks_of(nodes, levels)]
    return pd.DataFrame(made, columns=["tree", "place", "size", "hash"])


def _climb(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """Written tables of nodes, each of the tops of the one before, until every tree has one."""
    layers = [nodes]
    while largest > 1:
        tops = _superblock(layers[-1].select("tree", "place", "size", "hash"), levels).groupBy("_g1", "_g2").applyInPandas(lambda nodes: _tops(nodes, levels), _NODE)
        layers.append(materialize(tops, "tops"))
        largest = -(-largest // ARITY**levels)
    return layers


def _outer_of(outer: pd.DataFrame) -> dict[tuple[int, int], tuple]:
    return {(int(t), int(p)): (list(a), list(b), s) for t, p, a, b, s in zip(outer["tree"], outer["place"], outer["lefts"], outer["rights"], outer["subroot"], strict=True)}


def _hand_down(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Siblings up to the root of each node of some superblocks."""
    above, made = _outer_of(outer), []
    for tree, block, size, part in _blocks_of(nodes, levels):
        rows, (lefts, rights, subroot) = reduced(list(part["hash"]), size, levels), above[tree, block]
        for i, place in enumerate(part["place"]):
            left, right = siblings(rows, i)
            made.append((tree, int(place), size, left + lefts, right + rights, subroot))
    return pd.DataFrame(made, columns=["tree", "place", "size", "lefts", "rights", "subroot"])


def _finish(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof and folded root of each leaf of some superblocks."""
    above, made = _outer_of(outer), []
    for tree, block, size, part in _blocks_of(nodes, levels):
        rows, (lefts, rights, subroot) = reduced(list(part["hash"]), size, levels), above[tree, block]
        outside = "".join(a + b for a, b in zip(lefts, rights, strict=True))
        for i, (doc_id, leaf, other) in enumerate(zip(part["doc_id"], part["hash"], part["tampered"], strict=True)):
            left, right = siblings(rows, i)
            inside = "".join(a + b for a, b in zip(left, right, strict=True))
            proof = hashlib.sha256((inside + outside).encode()).hexdigest()
            made.append((doc_id, leaf, subroot, proof, folded(other, left + lefts, right + rights)))
    return pd.DataFrame(made, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def _with_levels(step: Callable, levels: int) -> Callable:
    return lambda nodes, outer: step(nodes, outer, levels)


def _down(layers: list[DataFrame], outer: DataFrame, run: Callable, schema: str, levels: int) -> DataFrame:
    """Cogroup each layer's superblocks with the outer siblings of their tops, from the last layer but one to the first; ``run`` takes the first."""
    for i in range(len(layers) - 2, -1, -1):
        # A tree whose layer above is its top alone has one superblock here, and so lies in a group of small trees.
        group = F.when(F.col("size") == 1, _small(F.col("tree"))).otherwise(F.col("tree"))
        above = outer.withColumns({"_g1": group, "_g2": F.col("place")}).groupBy("_g1", "_g2")
        below = _superblock(layers[i], levels).groupBy("_g1", "_g2")
        step, kind = (run, schema) if i == 0 else (_hand_down, _OUTER)
        outer = below.cogroup(above).applyInPandas(_with_levels(step, levels), kind)
    return outer


def manifest(docs: DataFrame, tampered_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is ``leaf_hash`` of doc_id, source, lang, n_chars and text. Per source leaves
    ascend by doc_id (null first), rows of one doc_id by their leaf; sources ascend by their UTF-8
    bytes, null first. ``tampered_text`` is an expression over the columns of ``docs`` whose value stands for the text of the
    leaf that is folded with the original siblings; absent, it is the text itself, and
    every row verifies. A superblock has 3^``levels`` nodes. Texts and sources are of any length; an empty table gives an
    empty result; extra columns are ignored; repeated rows are leaves of their own.
    """
    given = {name: F.col(f"`{name}`") for name in FIELDS}
    other = given["text"] if tampered_text is None else tampered_text
    leaves = docs.select(
        given["doc_id"].alias("doc_id"),
        given["source"].isNotNull().alias("_known"),
        F.coalesce(given["source"].cast("string"), F.lit("")).alias("_source"),
        leaf_hash(**given).alias("hash"),
        leaf_hash(**{**given, "text": other}).alias("tampered"),
    )
    placed = materialize(numbered(leaves, ["_known", "_source"], ["doc_id", "hash"]), "leaves")
    sizes = placed.groupBy("_known", "_source").agg((F.max("place") + 1).alias("size"))
    trees = materialize(numbered(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_known", "_source"], "tree"), "trees").drop("_all")
    sized = materialize(placed.join(trees, ["_known", "_source"]).select("tree", "place", "size", "hash", F.col("doc_id").cast("string").alias("doc_id"), "tampered"), "placed")
    bounds = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    if not bounds[1]:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").withColumns({c: F.lit("") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}).withColumn("verified", F.lit(True)).schema)
    # Every tree takes the same number of layers, one at least; the tops of one-node trees are themselves.
    layers = _climb(sized, max(2, bounds[0]), levels)
    subroots = layers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(bounds[1]).cast("long").alias("size"), "hash")
    above = _climb(subroots, max(2, bounds[1]), levels)
    root = above[-1].first()["hash"]
    none = F.array().cast("array<string>")
    top = above[-1].select("tree", "place", "size", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"))
    of_sources = _down(above, top, _hand_down, _OUTER, levels).select(F.col("place").alias("tree"), "lefts", "rights")
    tops = layers[-1].select("tree", "place", "size", F.col("hash").alias("subroot"))
    outer = materialize(tops.join(of_sources, "tree"), "outer")
    proofs = _down(layers, outer, _finish, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string", levels)
    return proofs.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )


def without_newlines(doc_id: Column, text: Column) -> Column:
    """The stated tampering: where 2 divides crc32 of the id's decimal form, the text loses its newlines."""
    even = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
