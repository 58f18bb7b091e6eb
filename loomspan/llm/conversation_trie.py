"""A trie of conversation prefixes by ROLLUP over positional columns of turns.

A turn's identifier is a pair of 64-bit hashes of its place, role and text (by their
SHA-256), and a prefix is named by its length and the XOR of its turns' identifiers, so
a prefix's name follows from its parent's without walking the trie. A conversation is
laid out in blocks of ``BLOCK`` columns, each keyed by the name of the node it continues,
and one ``GROUP BY block, key, ROLLUP(t1, ..)`` makes the nodes of all blocks of all
lengths together. Names are equal for unlike prefixes by a chance of some 2^-128 a pair;
they aren't proof against turns that someone makes up to clash.

Sums over subtrees need no walk either. Each node is owned by its smallest member.
What lies below a node is what its members own from its depth on, so a subtree's sum is a
sum over members of a suffix sum along each member's own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow, text_or_empty
from loomspan.llm.numbering import numbered
from loomspan.session import materialize

#: Turns that stand in the columns of one block.
BLOCK = 8
#: Turns of a conversation that one task takes together; longer conversations are taken in slices.
SLICE = 4096
#: Conversations whose ids are joined to one text before they are digested.
TOGETHER = 2000
#: Fixed value: a word of a turn's text.
TURN_WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, n_words`` of each turn, its place counted from 0.

    Turns are ordered by ``turn``, null first; turns of equal number by the digest of
    role and text. A null role or text is empty. A row without a conv_id belongs to no
    conversation and is left out; repeated rows are turns of their own.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.select(
        F.col("conv_id").try_cast("long").alias("conv_id"),
        F.col("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(TURN_WORD)).cast("long").alias("n_words"),
    ).filter("conv_id IS NOT NULL")
    return numbered(rows, ["conv_id"], ["turn", "digest"]).drop("turn")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: ``turns_of`` anew, and all conv_ids.

    Of conversation c the first h turns are those of conversation c - c % ``every``
    (all if it has fewer, none if it is absent), and c's own turns after its first h
    follow; h is crc32 of c's decimal form modulo ``most``.
    """
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("long")
    ids = turns.select("conv_id").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("_n"))
    convs = materialize(ids.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n"), "convs")
    first = convs.join(heads, "base").filter("place < h").select("conv_id", "place", "digest", "n_words")
    rest = turns.join(convs, "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_words")
    return first.unionByName(rest), convs.select("conv_id")


def _paths(turns: DataFrame) -> DataFrame:
    """Each turn as a step of its conversation's path: depth, its identifier (a, b), and the node (k1, k2) that it leads to.

    The running XOR is taken in slices, and the XOR of earlier slices is added to it.
    """
    lane = lambda n: F.xxhash64(F.lit(n), "place", "digest")
    steps = turns.select("conv_id", (F.col("place") + 1).alias("depth"), F.expr(f"place div {SLICE}").alias("_slice"), lane(1).alias("a"), lane(2).alias("b"), "n_words")
    so_far = Window.partitionBy("conv_id", "_slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = steps.groupBy("conv_id", "_slice").agg(F.bit_xor("a").alias("_a"), F.bit_xor("b").alias("_b"))
    carried = slices.select("conv_id", "_slice", F.bit_xor("_a").over(earlier).alias("_a"), F.bit_xor("_b").over(earlier).alias("_b")).filter("_slice > 0")
    local = steps.withColumns({"k1": F.bit_xor("a").over(so_far), "k2": F.bit_xor("b").over(so_far)})
    joined = local.join(carried, ["conv_id", "_slice"], "left")
    xor = lambda k, c: F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0)))
    return joined.select("conv_id", "depth", "a", "b", "n_words", xor("k1", "_a").alias("k1"), xor("k2", "_b").alias("k2"))


def _blocks(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each ``BLOCK`` turns: what node they continue (k1, k2) and the turns in columns t1, t2, ..; one for a turnless conversation."""
    at = (F.col("depth") - 1) % BLOCK
    names = ["a", "b", "n_words"]
    columns = [F.max(F.when(at == i, F.col(c))).alias(f"{c}{i}") for i in range(BLOCK) for c in names]
    before = [F.max(F.when(at == 0, F.col(k).bitwiseXOR(F.col(c)))).alias(k) for k, c in (("k1", "a"), ("k2", "b"))]
    grouped = paths.groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block")).agg(*before, *columns)
    turn = lambda i: F.when(F.col(f"a{i}").isNotNull(), F.struct(*[F.col(f"{c}{i}").alias(c) for c in names]))
    shaped = grouped.select("conv_id", "block", "k1", "k2", *[turn(i).alias(f"t{i + 1}") for i in range(BLOCK)]).join(lengths, "conv_id")
    none = [F.lit(None).cast("struct<a:bigint,b:bigint,n_words:bigint>").alias(f"t{i + 1}") for i in range(BLOCK)]
    zero = [F.lit(0).cast("long").alias(c) for c in ("block", "k1", "k2")]
    return shaped.unionByName(lengths.filter("n = 0").select("conv_id", *zero, *none, "n"))


def _xor(start: str, turns: list[str], field: str) -> Column:
    return reduce(lambda x, t: x.bitwiseXOR(F.coalesce(F.col(f"{t}.{field}"), F.lit(0))), turns, F.col(start))


def _nodes(blocks: DataFrame) -> DataFrame:
    """The trie's nodes: depth, name, parent's name, smallest member, number of members, longest member, words of the last turn."""
    ts = [f"t{i + 1}" for i in range(BLOCK)]
    rolled = blocks.sparkSession.sql(
        f"""SELECT block, k1, k2, {", ".join(ts)}, {BLOCK} - bit_count(grouping_id()) AS level,
                   min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest
            FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({", ".join(ts)})""",
        blocks=blocks,
    )
    last = F.get(F.array(*ts), F.col("level") - 1)
    real = rolled.withColumn("_last", last).filter("_last IS NOT NULL OR (level = 0 AND block = 0)")
    step = lambda c: F.coalesce(F.col(f"_last.{c}"), F.lit(0))
    return (
        real.select("conv_id", (F.col("block") * BLOCK + F.col("level")).alias("depth"), "n_convs", "longest", step("n_words").alias("n_words"), _xor("k1", ts, "a").alias("k1"), _xor("k2", ts, "b").alias("k2"), step("a").alias("_a"), step("b").alias("_b"))
        .withColumns({"p1": F.col("k1").bitwiseXOR(F.col("_a")), "p2": F.col("k2").bitwiseXOR(F.col("_b"))})
        .drop("_a", "_b")
    )


def _subtrees(nodes: DataFrame, paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """``n_children, n_leaves, saved_tokens`` of each node, by its members' suffix sums over the nodes they own."""
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("longest") == F.col("depth")).cast("long").alias("leaf"), F.lit(1).cast("long").alias("mine"))
    zero = F.lit(0).cast("long")
    every = paths.select("conv_id", "depth", "k1", "k2").unionByName(lengths.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    owners = own.select("conv_id").distinct()
    steps = every.join(owners, "conv_id", "left_semi").join(own, ["conv_id", "depth"], "left").withColumn("_slice", F.expr(f"depth div {SLICE}")).fillna(0, ["saved", "leaf", "mine"])
    first = F.max(F.when(F.col("depth") % SLICE == 0, F.col("mine")))
    slices = steps.groupBy("conv_id", "_slice").agg(F.sum("saved").alias("_saved"), F.sum("leaf").alias("_leaf"), first.alias("_mine"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_slice"))
    past = later.rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("conv_id", "_slice", F.sum("_saved").over(past).alias("_saved"), F.sum("_leaf").over(past).alias("_leaf"), F.lag("_mine").over(later).alias("_mine")).filter("_leaf IS NOT NULL")
    down = Window.partitionBy("conv_id", "_slice").orderBy(F.desc("depth"))
    to_here = down.rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select("conv_id", "_slice", "depth", "k1", "k2", F.sum("saved").over(to_here).alias("saved"), F.sum("leaf").over(to_here).alias("leaf"), F.lag("mine").over(down).alias("kid"))
    joined = local.join(carried, ["conv_id", "_slice"], "left")
    whole = joined.select(
        "depth", "k1", "k2", (F.col("saved") + F.coalesce("_saved", zero)).alias("saved"), (F.col("leaf") + F.coalesce("_leaf", zero)).alias("leaf"), F.coalesce("kid", "_mine", zero).alias("kid")
    )
    return whole.groupBy("depth", "k1", "k2").agg(F.sum("kid").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, conv_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of ``turns`` (as ``turns_of`` gives them), and the ends of conversations.

    One row per node: ``depth, k1, k2`` (its name), ``conv_id`` (its smallest member),
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``. The ends: ``depth, k1, k2, conv_id``, a row per conversation.
    ``conv_ids`` names all conversations, turnless ones too; if it is empty, so is
    the trie. Conversations of any length and nodes with any number of members
    are taken in slices and sums that combine before they are shuffled.
    """
    paths = materialize(_paths(turns), "paths")
    counts = paths.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lengths = materialize(conv_ids.join(counts, "conv_id", "left").fillna(0, ["n"]), "lengths")
    blocks = materialize(_blocks(paths, lengths), "blocks")
    nodes = materialize(_nodes(blocks), "nodes")
    name = ["depth", "k1", "k2"]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    trie = nodes.join(parents, ["depth", "p1", "p2"], "left").join(_subtrees(nodes, paths, lengths), name)
    ts = [f"t{i + 1}" for i in range(BLOCK)]
    last = blocks.filter((F.col("n") <= (F.col("block") + 1) * BLOCK))
    ends = last.select(F.col("n").alias("depth"), _xor("k1", ts, "a").alias("k1"), _xor("k2", ts, "b").alias("k2"), "conv_id")
    return trie.select(*name, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


_PIECE = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _join_ids(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Ids of one node, sorted, as texts of at most ``together`` ids."""
    node, ids = None, []
    for batch in batches:
        done = []
        for *at, conv in _rows(batch):
            if ids and (at != node or len(ids) == together):
                done.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = at
            ids.append(conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _PIECE.types, strict=True)], schema=_PIECE)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, ids[0], ",".join(map(str, ids))), _PIECE.types, strict=True)], schema=_PIECE)


def _fold_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes' pieces in order; only a hash's state is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for *at, _, ids in _rows(batch):
            if at == node:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((*node, state.hexdigest()))
            node, state = at, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, state.hexdigest()), _DIGEST.types, strict=True)], schema=_DIGEST)


def ends_digest(ends: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``depth, k1, k2, ends_sha256``: the digest of the ids that end in a node, ascending, joined by commas.

    Ids are sorted and joined to pieces by ranges, however many end in one node, and a
    digest, which has an order, is taken over the few pieces.
    """
    name = ["depth", "k1", "k2"]
    ends = materialize(ends, "ends")
    pieces = map_arrow(ends.select(*name, "conv_id").repartitionByRange(*name, "conv_id").sortWithinPartitions(*name, "conv_id"), lambda batches: _join_ids(batches, together), "depth long, k1 long, k2 long, first long, ids string")
    return map_arrow(pieces.repartition(*name).sortWithinPartitions(*name, "first"), _fold_ids, "depth long, k1 long, k2 long, ends_sha256 string")


def digest(trie: DataFrame, ends: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The trie with ``ends_sha256`` in place of the nodes' names; of a node in which none ends, the digest of nothing."""
    none = F.lit(hashlib.sha256(b"").hexdigest())
    name = ["depth", "k1", "k2"]
    return trie.join(ends_digest(ends, together), name, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("k1", "k2")
