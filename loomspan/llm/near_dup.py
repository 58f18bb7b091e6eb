"""Near-duplicates by Order MinHash, verified by banded alignment.

A document's five-word k-mers are numbered by occurrence, so that repeated ones
differ. A sketch takes the two least of them under a random order of all k-mers,
and keeps them in the order of the text; two documents share it if they have the
k-mers in common and in the same order. As scattered changes leave few k-mers of
five words in common, the least k-mer of each order is a further sketch on its own. Documents that share
any of these sketches are candidates, and candidates are aligned word by word within the band of
diagonals that a similarity of 0.8 allows. Short texts have sketches of k-mers of two words too.

Equal texts are one node with a number. Within a bucket first every node is compared with the
bucket's hub and classes are formed, in large buckets then with the node nearest to it; then, in buckets that still hold several
classes, all nodes of different classes are compared: in small buckets as they are.
In large ones the marks of all nodes are compared, in blocks of two parts of the bucket, and only what
they let pass is written. The shortest texts have their rarest threes of words as further
sketches: any two that are similar have one of these in common.

Before the texts of two candidates are fetched, their marks are compared: of each
text 512 bits or more, at least four a word, that its words turn over, of which d
changed words change 2 d at most. Before texts are aligned, their words are counted.
Pairs that differ in more than a similarity of 0.8 allows go, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow, packed, row_key, word_bytes
from loomspan.llm.components import components
from loomspan.llm.decontaminate import bit_set
from loomspan.session import bound_batches, discard, materialize

#: Words of a k-mer, sketches of a document, k-mers of a sketch, least similarity.
KMER, SKETCHES, PICKED, SIMILAR = 5, 16, 2, 0.8
#: Longs of a text's marks at least, which rule out most candidates before their texts are fetched; and at most in a block.
MARKS, MARKS_BESIDE = 8, 128
#: Bins of marks for each word, so that few changed words hide in the same ones.
BINS_A_WORD = 4
#: Nodes of a bucket that are compared in all pairs; the marks of larger ones' nodes are compared in blocks. Bins of the histogram of threes.
SMALL, BINS = 16, 1 << 18
#: Words of a text up to which it also has sketches of k-mers of two words, as few changes leave a short text no longer one in common,
#: and words up to which a text is met by its rarest threes of words, with texts of any length.
SHORT, SHORTEST = 64, 12
#: Nodes of one part of a large bucket; a task compares two parts.
TOGETHER = 2048
#: Words a worker remembers, rows of an output batch, places that are put in order at once.
REMEMBERED, ROWS, ORDERED = 300_000, 256, 1 << 16

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Word -> 64-bit hash; remembers up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def labelled_kmers(hashes: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of the k-mers in text order, equal ones told apart by their occurrence number."""
    n = max(1, len(hashes) - k + 1)
    width = min(k, len(hashes))
    kmers = np.zeros(n, np.uint64)
    for j in range(width):
        kmers += hashes[j : j + n] * _STEP[j]
    kmers = _mix(kmers)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if same.any():
        index = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, index))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (index - first).astype(np.uint64)
        # A first occurrence has the same hash in a text with repeated k-mers as in one without.
        kmers = np.where(occurrence > 0, _mix(kmers + occurrence * _STEP[31]), kmers)
    return kmers


def sketches(hashes: np.ndarray) -> np.ndarray:
    """The sketches of a document, given its words' hashes: per order first of the least k-mers as they stand in the text, then of the least alone;
    of a short text also of its least k-mers of two words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    whole = _sketched(labelled_kmers(hashes))
    if len(hashes) > SHORT / SIMILAR:
        return whole
    return np.concatenate([whole, _sketched(labelled_kmers(hashes, 2))[:SKETCHES]])


def _sketched(kmers: np.ndarray) -> np.ndarray:
    out = np.empty((2, SKETCHES), np.uint64)
    at_once = max(1, ORDERED // len(kmers))
    for i in range(0, SKETCHES, at_once):
        orders = _SEEDS[i : i + at_once]
        order = _mix((kmers ^ orders[:, :1]) * orders[:, 1:])
        picked = np.empty((len(orders), min(PICKED, len(kmers))), np.int64)
        for j in range(picked.shape[1]):
            picked[:, j] = order.argmin(axis=1)
            order[np.arange(len(orders)), picked[:, j]] = _LAST
        out[1, i : i + at_once] = kmers[picked[:, 0]]
        out[0, i : i + at_once] = (kmers[np.sort(picked, axis=1)] * _STEP[: picked.shape[1]]).sum(axis=1, dtype=np.uint64)
    return _mix(out).view(np.int64).ravel()


def marks(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * MARKS bins, doubled until there are ``BINS_A_WORD``, whether an odd number of the words falls into it, as bits.

    Equal words are told apart by their occurrence number, as two of a kind would leave no mark. A replaced word
    changes two bits at most, one put in or left out changes one: of a word's occurrences only the last one comes or goes.
    """
    bins = max(64 * MARKS, 1 << (BINS_A_WORD * len(hashes) - 1).bit_length() if len(hashes) else 0)
    if len(hashes):
        hashes = labelled_kmers(hashes, 1)
    odd = np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alignment_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Words to insert, delete or replace to turn ``a`` into ``b``; None if more than ``limit``.

    Only diagonals within ``limit`` of the main one are followed, all of a
    column's at once as the bits of one number.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    unequal = np.flatnonzero(a[: len(b)] != b)
    head = int(unequal[0]) if len(unequal) else len(b)
    a, b = a[head:], b[head:]
    if len(b):
        unequal = np.flatnonzero(a[::-1][: len(b)] != b[::-1])
        tail = int(unequal[0]) if len(unequal) else len(b)
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(b):
        return len(a) if len(a) <= limit else None
    limit_now = min(limit, len(a))
    width = 2 * limit_now + 2
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full ^ ((1 << (width - limit_now - 1)) - 1), 0
    distance, diagonal, horizontal = limit_now, 1 << (width - 1), 1 << (width - 2)
    give_up = 2 * limit_now + len(b) - len(a)
    shift = limit_now + 1 - width
    for j, x in enumerate(b.tolist()):
        match = places.get(x, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        zero = ((((match & up) + up) & full) ^ up) | match | down
        rise = down | (full ^ (zero | up))
        fall = zero & up
        if j < len(a) - limit_now:
            distance += not zero & diagonal
        else:
            distance += bool(rise & horizontal) - bool(fall & horizontal)
            horizontal >>= 1
        if distance > give_up:
            return None
        zero >>= 1
        up = fall | (full ^ (zero | rise))
        down = zero & rise
        shift += 1
    return distance if distance <= limit else None


def words_in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts share, whatever their order."""
    (words_a, n_a), (words_b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(words_a, words_b, assume_unique=True, return_indices=True)
    return int(np.minimum(n_a[i], n_b[j]).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float | None:
    """1 less the distance over the longer text's words, if that is ``least`` or more.

    Every word of the longer text that the other lacks is a change, so words are counted first.
    """
    longest = max(len(a), len(b))
    limit = int((1 - least) * longest + 1e-9)
    distance = alignment_distance(a, b, limit) if longest - words_in_common(a, b) <= limit else None
    return None if distance is None else 1 - distance / longest


def prints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Per row with its key: doc_id, node (digest of its words), word count, sketches, marks, and words as numbers."""
    narrow = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "_k1", "_k2", F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                nodes, counts, prints_, marked, terms = [], [], [], [], []
                for text in batch.column("_text").to_pylist():
                    found = word_bytes(text)
                    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
                    nodes.append(hashlib.md5(b" ".join(found), usedforsecurity=False).hexdigest())
                    counts.append(len(found))
                    prints_.append(sketches(hashes))
                    marked.append(marks(hashes))
                    terms.append((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_k1"), batch.column("_k2"), pa.array(nodes), pa.array(counts, pa.int32()), pa.array(prints_, pa.list_(pa.int64())), pa.array(marked, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int32()))],
                    names=["doc_id", "_k1", "_k2", "node", "n_words", "sketches", "marks", "terms"],
                )

    return map_arrow(narrow, run, "doc_id long, _k1 long, _k2 long, node string, n_words int, sketches array<long>, marks array<long>, terms array<int>")


def _bits_allowed(words_a: str, words_b: str) -> Column:
    """How many marks of similar texts with these word counts may differ.

    Of the d changes that the similarity allows at most, as many as the texts
    differ in length put words in or leave them out.
    """
    a, b = F.col(words_a), F.col(words_b)
    return 2 * F.floor((1 - SIMILAR) * F.greatest(a, b) + 1e-9) - F.abs(a - b)


def _folded(marks_: Column, longs: Column) -> Column:
    """Marks as they are with fewer bins, which are bins put together."""

    def put_together(i: Column) -> Column:
        return F.aggregate(F.filter(marks_, lambda _, j: j % longs == i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    return F.when(F.size(marks_) <= longs, marks_).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), put_together))


def _marks_allow(words_a: str, marks_a: str, words_b: str, marks_b: str) -> Column:
    """Whether texts with these word counts and marks can be similar; true of all that are."""
    longs = F.least(F.size(marks_a), F.size(marks_b))
    differing = F.zip_with(_folded(F.col(marks_a), longs), _folded(F.col(marks_b), longs), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda x, y: x + y) <= _bits_allowed(words_a, words_b)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their marks don't rule out."""
    ends = [nodes.select(F.col("id").alias(x), F.col("n_words").alias(f"_n{x}"), F.col("marks").alias(f"_m{x}")) for x in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").filter(_marks_allow("_na", "_ma", "_nb", "_mb")).select("a", "b")


def _those(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (id, terms) that a bit set of fixed size of the wanted ids lets pass: all wanted ones, and some others where it is crowded.

    It keeps what isn't wanted out of the shuffle that follows.
    """
    bits = np.packbits(bit_set(wanted.select(F.xxhash64("id").alias("term"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(bits).astype(bool)
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            yield batch.select(["id", "terms"]).filter(pa.array(passes[at & (len(passes) - 1)]))

    return map_arrow(texts.select("id", "terms", F.xxhash64("id").alias("at")), run, "id long, terms array<int>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment is similar enough, with the similarity."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _those(texts, wanted).join(wanted, "id", "left_semi")
    left = texts.select(F.col("id").alias("a"), F.col("terms").alias("_ta"))
    right = texts.select(F.col("id").alias("b"), F.col("terms").alias("_tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_ta"), batch.column("_tb")
            found = [
                similar(a[i].values.to_numpy(zero_copy_only=False), b[i].values.to_numpy(zero_copy_only=False)) for i in range(batch.num_rows)
            ]
            kept = pa.array([x is not None for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array([x for x in found if x is not None], pa.float64())],
                names=["a", "b", "similarity"],
            )

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb"), run, "a long, b long, similarity double")


def _long_enough(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-9


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _hub(*columns: str) -> list[Column]:
    """The columns of a group's node that comes first by a hash of its words, so that near copies have one hub in most of their groups."""
    return [F.min_by(c, "by").alias(f"hub_{c}") for c in columns]


def _pairs_within(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of different classes in small groups, and the rows of large groups with their size."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    sized = rows.join(groups.filter("_low < _high").select(*keys, "_n"), keys)
    small = sized.filter(F.col("_n") <= SMALL)
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    on += [F.col("x.id") < F.col("y.id"), F.col("x.root") != F.col("y.root"), _long_enough(F.col("x.n_words"), F.col("y.n_words"))]
    pairs = small.alias("x").join(small.alias("y"), on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return pairs, sized.filter(F.col("_n") > SMALL)


def _meeting(words: np.ndarray, marked: list[np.ndarray], roots: np.ndarray, parts: np.ndarray, across: bool, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which two of a block's texts, by place, have different classes and word counts and marks that similar texts can have.

    With ``across``, only texts of different parts are paired. With ``nearest``, each text is paired only with
    the one whose marks leave most room.
    """
    order = np.argsort(words, kind="stable")
    words, roots, parts = words[order], roots[order], parts[order]
    longs = np.array([len(marked[i]) for i in order])
    ends = np.searchsorted(words, words / SIMILAR + 1e-6, "right")
    one, other, room = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for size in np.unique(longs):  # no longer text has fewer marks
        low, high = np.flatnonzero(longs == size)[[0, -1]] + [0, 1]
        folded = np.stack([np.bitwise_xor.reduce(marked[i].view(np.uint64).reshape(-1, size), axis=0) for i in order[low : ends[high - 1]]])
        for i in range(low, high, ROWS):
            until = min(i + ROWS, high)
            rows, columns = slice(i, until), slice(i, ends[until - 1])
            differing = np.zeros((until - i, ends[until - 1] - i), np.int32)
            for k in range(size):
                differing += np.bitwise_count(folded[i - low : until - low, k, None] ^ folded[None, i - low : ends[until - 1] - low, k])
            longest, shortest = words[None, columns], words[rows, None]
            left = 2 * np.floor((1 - SIMILAR) * longest + 1e-9) - (longest - shortest) - differing
            meets = (left >= 0) & (shortest >= SIMILAR * longest - 1e-9) & (roots[rows, None] != roots[None, columns])
            meets &= np.arange(i, until)[:, None] < np.arange(i, ends[until - 1])[None]
            if across:
                meets &= parts[rows, None] != parts[None, columns]
            x, y = np.nonzero(meets)
            one.append(order[x + i])
            other.append(order[y + i])
            room.append(left[x, y])
    one, other, room = map(np.concatenate, (one, other, room))
    if nearest:
        most = np.argsort(-room, kind="stable")
        most = most[np.unique(np.concatenate([np.unique(end[most], return_index=True)[1] for end in (one, other)]))]
        one, other = one[most], other[most]
    return one, other


def _pairs_of_large(rows: DataFrame, keys: list[str], nodes: DataFrame, nearest: bool = False) -> DataFrame:
    """All pairs of different classes in large groups that word counts and marks don't rule out, or only each text's nearest of its own part.

    Groups are parted, and a task takes the marks of two parts: what is compared grows with a group's square,
    what is written only with the pairs that can be similar.
    """
    parts = F.ceil(F.col("_n") / TOGETHER)
    once = ["sketches"] if "band" in keys and not nearest else []
    dealt = (
        rows.withColumn("_part", F.pmod(F.xxhash64("id"), parts))
        .withColumn("_met", F.col("_part") if nearest else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("id", "n_words", "root", "_part", *keys, F.least("_part", "_met").alias("_p"), F.greatest("_part", "_met").alias("_q"))
        .join(nodes.select("id", _folded(F.col("marks"), F.lit(MARKS_BESIDE)).alias("marks"), *once), "id")
    )

    def run(block: pa.Table) -> pa.Table:
        words, ids, roots, part, p, q = (block.column(c).to_numpy() for c in ("n_words", "id", "root", "_part", "_p", "_q"))
        marked = [x.values.to_numpy(zero_copy_only=False) for x in block.column("marks")]
        one, other = _meeting(words, marked, roots, part, p[0] != q[0], nearest)
        band = block.column("band")[0].as_py() if once else 3 * SKETCHES
        if band < 3 * SKETCHES:  # a pair of several buckets is told in the first one, which is compared too
            own = np.zeros((len(ids), 3 * SKETCHES), np.int64)
            for i, x in enumerate(block.column("sketches")):
                own[i, : len(x)] = x.values.to_numpy(zero_copy_only=False)
            told = [np.zeros(0, bool)] + [(own[one[i : i + ORDERED]] == own[other[i : i + ORDERED]]).argmax(axis=1) == band for i in range(0, len(one), ORDERED)]
            one, other = one[np.concatenate(told)], other[np.concatenate(told)]
        return pa.table({"a": np.minimum(ids[one], ids[other]), "b": np.maximum(ids[one], ids[other])})

    bound_batches(rows.sparkSession)
    return dealt.groupBy(*keys, "_p", "_q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, n_found, kept.

    Rows are in one class if a chain of links joins them; a link is an alignment
    similarity of 0.8 or more between texts that share a sketch or, where one has at most ``SHORTEST``
    words, any of their rarest threes of words, which all such
    texts that are similar do. Buckets of any size are compared whole. ``class_id`` is
    the least doc_id of the class and ``kept`` marks the rows that have it;
    ``n_found`` counts
    the links found from the row's text to others, which join the class; as pairs that
    already are in one class aren't compared further, it isn't the number of similar
    texts. Texts
    with the same words are equal. Texts without words, null ones too, are never
    duplicates: each is its own class. A text of fewer than five words is one
    k-mer; a text of any length is compared whole. Repeated rows are copies like any others. Other columns are not kept,
    and an empty table gives an empty result.
    """
    return _placed(row_key(docs.select("doc_id", F.col(text_column).alias("_text")), "doc_id", "_text"), "_text").drop("_k1", "_k2")


def _placed(docs: DataFrame, text_column: str) -> DataFrame:
    """The rows of ``near_duplicates`` with their keys."""
    printed = materialize(prints(docs, text_column).withColumn("id", F.monotonically_increasing_id()), "prints")
    nodes = materialize(printed.filter("n_words > 0").select("id", "node", "n_words", "sketches", "marks").dropDuplicates(["node"]), "nodes")
    found = links(printed, nodes)
    degree = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_found"))
    roots = components(found).withColumnRenamed("node", "id")
    of_node = nodes.select("id", "node").join(roots, "id", "left").join(degree, "id", "left")
    placed = (
        printed.select("doc_id", "_k1", "_k2", "node", "n_words")
        .join(materialize(of_node.select("node", F.coalesce("root", "id").alias("_root"), F.coalesce("n_found", F.lit(0)).alias("n_found")), "classes"), "node", "left")
        .select("doc_id", "_k1", "_k2", "_root", F.coalesce("n_found", F.lit(0)).alias("n_found"))
    )
    classes = placed.filter(F.col("_root").isNotNull()).groupBy("_root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = F.col("_root").isNull()
    return placed.join(classes, "_root", "left").select(
        "doc_id",
        "_k1",
        "_k2",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.col("n_found").cast("long").alias("n_found"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def links(printed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) between ids of ``nodes``, a < b, that join all similar texts which share a sketch.

    A node has the id of one of the rows of ``printed`` that have its words.
    """
    bucket = ["band", "h"]
    texts = printed.select("id", "terms")
    short = nodes.filter(F.col("n_words") <= SHORTEST / SIMILAR).select("id")
    rare = _rare_grams(printed.filter(F.col("n_words") <= SHORTEST / SIMILAR).select("id", "terms").join(short, "id", "left_semi"))
    named = nodes.select("id", F.xxhash64("node").alias("by"), "n_words")
    banded = named.join(rare.select("id", (3 * SKETCHES + F.pmod("gram", F.lit(SKETCHES))).cast("int").alias("band"), F.col("gram").alias("h")), "id")
    banded = banded.unionByName(nodes.select("id", F.xxhash64("node").alias("by"), "n_words", F.posexplode("sketches").alias(*bucket)))
    hubs = banded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), *_hub("id", "n_words")).filter("_n > 1").drop("_n")
    shared = materialize(banded.join(hubs, bucket), "buckets")
    beside = shared.filter((F.col("id") != F.col("hub_id")) & _long_enough(F.col("n_words"), F.col("hub_n_words")))
    first = materialize(_plausible(beside.select(*_pair("hub_id", "id")).distinct(), nodes), "pairs")
    linked = materialize(_verified(first, texts), "links")

    # Nearest texts first, which join most of what belongs together, so that few pairs of different classes are left.
    _, large, roots = _rest(shared, bucket, linked)
    nearest = materialize(_pairs_of_large(large, bucket, nodes, nearest=True).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    linked = _with_more(linked, _verified(nearest, texts))
    discard(roots)
    second, large, roots = _rest(shared, bucket, linked)
    tried = first.unionByName(nearest)
    # Large buckets' pairs have been held against marks in their blocks.
    second = _plausible(second.distinct(), nodes).unionByName(_pairs_of_large(large, bucket, nodes)).distinct()
    second = materialize(second.join(tried, ["a", "b"], "left_anti"), "pairs")
    linked = _with_more(linked, _verified(second, texts))
    discard(shared, roots, rare, first, nearest, second)
    return linked


def _rest(shared: DataFrame, bucket: list[str], linked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_pairs_within``, of the classes that the links make so far, and the table of these."""
    roots = materialize(components(linked).withColumnRenamed("node", "id"), "roots")
    rest = shared.select("id", "n_words", *bucket).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return *_pairs_within(rest, bucket), roots


def _with_more(linked: DataFrame, more: DataFrame) -> DataFrame:
    """Links with further ones, in place of the table that they were in."""
    grown = materialize(linked.unionByName(more), "links")
    discard(linked)
    return grown


def _rare_grams(texts: DataFrame) -> DataFrame:
    """Of each text (id, terms) as many of its rarest threes of words (``gram``, ``at``) that two similar texts have one in common.

    Texts of n words or more that differ by d words have n - 2 - 3 d of their threes of words
    in common, which is 0.4 n - 2 at the least similarity. So in any order that
    is the same for all texts, the first 0.6 n + 1 of both have one in common. The
    order is by a histogram of all threes' hashes. Five words of which one differs may have no three in
    common; so texts of up to five words give all their twos too.
    """

    def grams_of(terms: pa.ListScalar) -> np.ndarray:
        hashes = terms.values.to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
        threes = labelled_kmers(hashes, 3)
        return threes if len(hashes) > 5 else np.concatenate([threes, labelled_kmers(hashes, 2)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BINS, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                totals += np.bincount((grams_of(terms) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["bin", "n"])

    totals = np.zeros(BINS, np.int64)
    found = map_arrow(texts.select("terms"), count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    totals[found.column("bin").to_numpy()] = found.column("n").to_numpy()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                picked = []
                for terms in batch.column("terms"):
                    grams = grams_of(terms)
                    order = np.lexsort((grams, totals[(grams % np.uint64(BINS)).astype(np.int64)]))
                    n = len(terms.values)
                    first = order[: int(3 * (1 - SIMILAR) * n + 1 + 1e-9)] if n > 5 else order
                    picked.append((grams[first].view(np.int64), (first % max(1, n - 2)).astype(np.int32) if n <= 5 else first.astype(np.int32)))
                owner = pa.array(np.repeat(np.arange(len(picked)), [len(at) for _, at in picked]))
                grams, at = (pa.array(np.concatenate(x)) for x in zip(*picked, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), grams, at], names=["id", "gram", "at"])

    return materialize(map_arrow(texts, pick, "id long, gram long, at int"), "grams")


def keep_one(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """One row of each class, with all columns of ``docs``: the one with the least doc_id.

    Rows go by their id and text, so a row of another class that repeats an id stays.
    Null ids come after all others. Where the least id of a class is repeated in it, all
    rows that have it stay, and so they do where all ids of a class are null.
    """
    narrow = row_key(docs.select(F.col("doc_id"), F.col(f"`{text_column}`").alias("_text")), "doc_id", "_text")
    gone = _placed(narrow, "_text").filter(~F.col("kept")).select("_k1", "_k2").distinct()
    return packed(docs, "doc_id", text_column).join(gone, ["_k1", "_k2"], "left_anti").select("_row.*")
