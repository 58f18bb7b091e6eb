"""K-d tree sharding: recursive weighted-median splits of the metadata space.

Rows with equal texts are one group, and a group is one point: id, source and language of its
row with the least id, and its size, every axis scaled to 0..1; it weighs as much as all
its rows. A node that has to become ``k`` shards is split along its widest axis,
at the weighted quantile that gives its halves bytes in proportion to the shards
they have to become. A level takes one aggregation that gives all its nodes' spans and
histograms at once, and then refines the bin that holds each quantile, one aggregation a
round. The driver sees only histograms, whose size depends on the number of shards and not on
the rows.

A group of more than a part of a shard's bytes can't stay together while sizes stay
near equal, so it goes in as several points, each a share of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import text_or_empty
from loomspan.session import materialize

#: Added to the UTF-8 bytes of each text.
ROW_OVERHEAD = 16
#: Bins an axis in a level's first aggregation, bins of one later round, bits of an axis value and of its tie-break.
FIRST_BINS, BINS, VALUE_BITS, TIE_BITS = 512, 4096, 20, 32
#: A median is exact to this share of a shard's bytes.
CLOSE = 2e-4
#: A group of more than a shard's bytes divided by this is parted.
PARTS = 4
#: Rows that one task numbers within a shard.
SLOT_ROWS = 50_000


@dataclass
class Node:
    """A part of the tree: leaves carry a shard, the others an axis and a threshold."""

    shards: int
    first: int
    low: list[int]
    high: list[int]
    axis: int = -1
    threshold: int = 0
    children: list[int] = field(default_factory=list)


def _text_code(column: Column) -> Column:
    """An order-preserving number of a string: its first seven bytes."""
    padded = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(padded, 16, 10).cast("double"), F.lit(0.0))


def _number(docs: DataFrame, name: str) -> Column:
    if name not in docs.columns:
        return F.lit(0.0)
    if dict(docs.dtypes)[name] == "string":
        return _text_code(F.col(f"`{name}`"))
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))


def _rows(docs: DataFrame, id_column: str, text_column: str, axes: tuple[str, ...]) -> DataFrame:
    """Id, size, checksum, digest of the text and the metadata as numbers; ``_n`` tells repeated rows apart."""
    text = F.encode(text_or_empty(F.col(f"`{text_column}`")), "UTF-8")
    narrow = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_text"),
        *[_number(docs, a).alias(f"_v{i}") for i, a in enumerate(axes)],
        F.monotonically_increasing_id().alias("_n"),
    )
    return materialize(narrow, "rows")


def _parted(rows: DataFrame, large: DataFrame, most: float) -> DataFrame:
    """The rows with ``_part``: 0, but for groups of more than ``most`` bytes, whose rows are dealt by their id.

    Groups that large (``large``), and ids that have that much of one, are at most as many as there are parts
    in all shards, so both are broadcast.
    """
    marked = rows.join(F.broadcast(large), "_text", "left")
    same = marked.filter("_parts > 1").groupBy("_text", "doc_id").agg(F.sum("size").alias("_b")).filter(F.col("_b") > most)
    same = same.select("_text", F.col("doc_id").alias("_id"), F.lit(True).alias("_same"))
    on = (F.col("r._text") == F.col("s._text")) & F.col("r.doc_id").eqNullSafe(F.col("s._id"))
    marked = marked.alias("r").join(F.broadcast(same).alias("s"), on, "left").select("r.*", "_same")
    by = F.when(F.col("_same"), F.xxhash64("_n")).otherwise(F.xxhash64("doc_id"))
    return marked.withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(by, F.col("_parts"))).otherwise(F.lit(0)).cast("long")).drop("_parts", "_same")


def _points(groups: DataFrame, bounds: list[tuple[float | None, float | None]]) -> DataFrame:
    """One 52-bit key per axis of each point: the scaled value, then a tie-break."""
    tie = F.shiftrightunsigned(F.xxhash64("_text", "_part"), 64 - TIE_BITS)

    def key(i: int, low: float | None, high: float | None) -> Column:
        if low is None or high <= low:
            return tie
        scaled = F.floor((F.col(f"_v{i}") - low) / (high - low) * (2**VALUE_BITS - 1)).cast("long")
        return F.shiftleft(scaled, TIE_BITS).bitwiseOR(tie)

    return groups.select("_text", "_part", "bytes", F.array(*[key(i, *b) for i, b in enumerate(bounds)]).alias("_keys"))


def _table(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _route(nodes: list[Node], depth: int) -> Column:
    """The node of a point after ``depth`` levels, as one expression over ``_keys``."""
    if not depth:
        return F.lit(0)
    axis = _table([n.axis for n in nodes]).cast("array<int>")
    threshold = _table([n.threshold for n in nodes])
    left = _table([n.children[0] if n.children else -1 for n in nodes]).cast("array<int>")

    def step(node: Column, _: Column) -> Column:
        is_leaf = F.get(axis, node) < 0
        low = F.get(F.col("_keys"), F.get(axis, node)) <= F.get(threshold, node)
        return F.when(is_leaf, node).when(low, F.get(left, node)).otherwise(F.get(left, node) + 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _histograms(at: DataFrame, axes: list[int], ranges: dict[tuple[int, int], tuple[int, int]], bins: int) -> dict[tuple[int, int], list]:
    """Per (node, axis) of ``ranges`` the bins of its keys within its range: (bytes, least key, greatest key), in order."""
    places = sorted(ranges)
    number = {p: i for i, p in enumerate(places)}
    nodes = max(n for n, _ in places) + 1
    index = _table([number.get((n, a), -1) for n in range(nodes) for a in axes]).cast("array<int>")
    low, high = (_table([ranges[p][k] for p in places]) for k in (0, 1))
    width = _table([max(1, -(-(ranges[p][1] - ranges[p][0] + 1) // bins)) for p in places])
    keys = F.array(*[F.struct(F.get(index, F.col("_node") * len(axes) + j).alias("p"), F.get("_keys", F.lit(a)).alias("key")) for j, a in enumerate(axes)])
    listed = at.select("bytes", F.explode(keys).alias("_k")).select("bytes", F.col("_k.p").alias("p"), F.col("_k.key").alias("key"))
    inside = listed.filter((F.col("p") >= 0) & F.col("key").between(F.get(low, F.col("p")), F.get(high, F.col("p"))))
    found = inside.groupBy("p", F.floor((F.col("key") - F.get(low, F.col("p"))) / F.get(width, F.col("p"))).alias("bin"))
    out: dict[tuple[int, int], list] = {p: [] for p in places}
    for r in sorted(found.agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()):
        out[places[r["p"]]].append((r["bytes"], r["low"], r["high"]))
    return out


def build_tree(points: DataFrame, n_shards: int, n_axes: int) -> tuple[list[Node], int]:
    """Split level by level until every leaf is one shard's target bytes."""
    nodes = [Node(n_shards, 0, [0] * n_axes, [(1 << VALUE_BITS + TIE_BITS) - 1] * n_axes)]
    depth, open_nodes = 0, [0] if n_shards > 1 else []
    while open_nodes:
        at = points.select("bytes", "_keys", _route(nodes, depth).alias("_node")).filter(F.col("_node").isin(open_nodes))
        ranges = {(i, a): (nodes[i].low[a], nodes[i].high[a]) for i in open_nodes for a in range(n_axes)}
        histograms = _histograms(at, list(range(n_axes)), ranges, FIRST_BINS)
        search = {}
        for i in open_nodes:
            node, total = nodes[i], sum(b for b, _, _ in histograms[i, 0])
            if not total:
                node.axis = 0
                continue
            node.low = [histograms[i, a][0][1] for a in range(n_axes)]
            node.high = [histograms[i, a][-1][2] for a in range(n_axes)]
            node.axis = max(range(n_axes), key=lambda a: (node.high[a] >> TIE_BITS) - (node.low[a] >> TIE_BITS))  # noqa: B023
            search[i] = (histograms[i, node.axis], 0, total * (node.shards // 2) / node.shards)
        _find_thresholds(at, nodes, search)
        following = []
        for i in open_nodes:
            node = nodes[i]
            half = node.shards // 2
            node.children = [len(nodes), len(nodes) + 1]
            for first, count, side in ((node.first, half, "high"), (node.first + half, node.shards - half, "low")):
                child = Node(count, first, list(node.low), list(node.high))
                getattr(child, side)[node.axis] = node.threshold + (side == "low")
                nodes.append(child)
            following += [c for c in node.children if nodes[c].shards > 1]
        open_nodes, depth = following, depth + 1
    return nodes, depth


def _find_thresholds(at: DataFrame, nodes: list[Node], search: dict[int, tuple[list, int, float]]) -> None:
    """Set each node's threshold: the key nearest to which its bytes reach the target.

    ``search`` holds per node the histogram of the range in question, the bytes below it and the target.
    """
    while search:
        ranges, following = {}, {}
        for i, (histogram, below, target) in search.items():
            node = nodes[i]
            node.threshold = histogram[-1][2]
            for size, low, high in histogram:
                if below + size >= target:
                    if low == high or size <= CLOSE * target / max(1, node.shards // 2):
                        node.threshold = high if target - below >= size / 2 else low - 1
                    else:
                        ranges[i, node.axis] = (low, high)
                        following[i] = (below, target)
                    break
                below += size
        if not ranges:
            return
        axes = sorted({a for _, a in ranges})
        histograms = _histograms(at, axes, ranges, BINS)
        search = {i: (histograms[i, nodes[i].axis], *rest) for i, rest in following.items()}


def shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    axes: tuple[str, ...] = ("doc_id", "source", "lang"),
) -> DataFrame:
    """Every row with its size, checksum, shard and slot; sizes of shards are near equal.

    Give either the number of shards or their target bytes. The law that holds is ``bytes``.
    Rows with equal texts are in one shard, unless they have more than a quarter of a shard's
    bytes: then the group is parted by id into shares of about that, and rows that repeat
    that much of one id too. A null text has no bytes and the checksum of an empty text, which
    it equals; null or missing metadata is 0 on its axis; ties on an axis are broken by a hash of the text;
    a single text of more than a shard's bytes makes its shard larger. Other columns are
    not kept, so no names clash. An empty table gives an empty result. Slots number a shard's
    rows from 0.
    """
    rows = _rows(docs, id_column, text_column, axes)
    spans = [f(f"_v{i}") for i in range(len(axes)) for f in (F.min, F.max)]
    first = F.min(F.struct("doc_id", *[f"_v{i}" for i in range(len(axes))]))
    whole = materialize(rows.groupBy("_text").agg(F.sum("size").alias("bytes"), first.alias("_first")), "groups")
    total, least, most, *bounds = rows.agg(F.sum("size"), F.min("size"), F.max("size"), *spans).first()
    total = total or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    largest = max(1.0, total / n_shards / PARTS)
    whole_part = F.lit(0).cast("long").alias("_part")
    every = whole.filter(F.col("bytes") <= largest).select("_text", whole_part, "bytes", "_first")
    large = whole.filter(F.col("bytes") > largest).select("_text", F.ceil(F.col("bytes") / largest).alias("_parts"))
    if large.isEmpty():
        rows = rows.withColumn("_part", whole_part)
    else:
        rows = materialize(_parted(rows, large, largest), "rows")
        split = rows.join(F.broadcast(large), "_text").groupBy("_text", "_part").agg(F.sum("size").alias("bytes"), first.alias("_first"))
        every = every.unionByName(split)
    every = every.select("_text", "_part", "bytes", "_first.*").withColumn(f"_v{len(axes)}", F.log2("bytes"))
    size_bounds = every.agg(F.min(f"_v{len(axes)}"), F.max(f"_v{len(axes)}")).first()
    points = materialize(_points(every, [*zip(bounds[::2], bounds[1::2], strict=True), tuple(size_bounds)]), "points")
    nodes, depth = build_tree(points, n_shards, len(axes) + 1)
    shard_of = _table([n.first for n in nodes]).cast("array<int>")
    placed = points.select("_text", "_part", F.get(shard_of, _route(nodes, depth)).alias("shard"))
    return _with_slots(rows.join(placed, ["_text", "_part"])).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number rows within shards: by hash bucket, and within a bucket by a window.

    A shard is numbered by as many tasks as it has buckets, of bounded rows each.
    """
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "_n"), "placed")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // SLOT_ROWS))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "_n"), F.lit(buckets)))
    starts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32", "_n")
    numbered = placed.withColumn("_r", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_r")).cast("long"))
