"""Benchmark decontamination with a distributed positional inverted index.

Training texts become rows of term numbers (64-bit hashes of words), once, whatever the
benchmark's size, and from these come the postings: term, document, position. A test phrase is
looked up by its rarest terms: each posting of the rarest one says where the phrase would begin, the
lists of the next ones, adjusted by their offsets in the phrase, must agree on that
place, and places that survive are compared word by word. Agreement within a few
positions gives a proximity match, agreement in all words an exact one.

The benchmark, its windows and their terms are tables like the postings, and joins are on
document, term and position, so neither a hot passage nor a hot term gathers in one task. Only a
bit set of fixed size goes to the executors: words that stand in no test are 0 from the start,
and terms that are not looked up have no postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow, packed, row_key, word_bytes
from loomspan.session import materialize

#: Consecutive words that make a window, and positions by which a proximity match may be off.
WINDOW, SLOP = 10, 4
#: Test terms of a window that are looked up, rarest first.
ANCHORS = 3
#: Bits of a bit set of terms, which may let other terms pass but loses none; bits of one row of it.
SET_BITS, ROW_BITS = 1 << 24, 1 << 15
#: Rows of an output batch, and words a worker remembers.
ROWS, REMEMBERED = 512, 300_000

_HIT = pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])
_HIT_SQL = "array<struct<item:string,start:int,end:int,exact:boolean>>"


class Terms(dict):
    """Word -> 64-bit hash, 0 if a bit set rules it out; remembers up to a bound."""

    def __init__(self, bits: np.ndarray | None) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word) or 1
        if self.bits is not None and not self.bits[found % len(self.bits)]:
            found = 0
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def bit_set(terms: DataFrame) -> np.ndarray:
    """The places of ``term`` among ``SET_BITS`` bits. At most SET_BITS / ROW_BITS short rows reach the driver."""
    place = F.col("term").bitwiseAND(SET_BITS - 1)
    rows = terms.groupBy((F.floor(place / ROW_BITS)).alias("row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("bits"))
    out = np.zeros(SET_BITS, bool)
    for row, bits in rows.collect():
        found = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")[:SET_BITS]
        out[row * ROW_BITS : row * ROW_BITS + len(found)] = found
    return out


def term_rows(keyed: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """``_text`` of each row as an array of terms by position, beside the number of its words and its other columns."""
    names = [*[c for c in keyed.columns if c != "_text"], "n_words", "_terms"]
    schema = ", ".join([*[f"{c} {t}" for c, t in keyed.dtypes if c != "_text"], "n_words long", "_terms array<long>"])
    packed_bits = None if bits is None else np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(None if packed_bits is None else np.unpackbits(packed_bits).astype(bool))
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                terms, ends = [], [0]
                for text in batch.column("_text").to_pylist():
                    found = word_bytes(text)
                    terms.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
                    ends.append(ends[-1] + len(found))
                flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
                kept = [batch.column(c) for c in names[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends), pa.int64()), column], names=names)

    return map_arrow(keyed, run, schema)


def test_windows(items: DataFrame, window: int) -> DataFrame:
    """``win`` (the window's terms) and ``items`` (which have it, sorted) of every distinct window of the test items."""
    size = F.least(F.lit(window), F.size("_terms"))
    places = F.sequence(F.lit(1), F.size("_terms") - size + 1)
    listed = items.filter(F.size("_terms") > 0).select("item", F.explode(F.transform(places, lambda i: F.slice("_terms", i, size))).alias("win"))
    return listed.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def looked_up(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose terms stand in the corpus, with their ``ANCHORS`` rarest terms (t0, t1, ...) and offsets (o0, ...)."""
    listed = windows.select("win", F.posexplode("win").alias("o", "term")).join(counts, "term", "left")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("n", "o", "term"))), 1, ANCHORS)  # a window's terms: at most ``window``
    rarest = listed.groupBy("win").agg(ranked.alias("r"), F.count("n").alias("known")).filter(F.col("known") == F.size("win"))

    def anchor(i: int, name: str) -> Column:
        return F.coalesce(F.get("r", F.lit(i))[name], F.get("r", F.lit(0))[name])

    columns = [anchor(i, name).alias(f"{short}{i}") for i in range(ANCHORS) for name, short in (("term", "t"), ("o", "o"))]
    return rarest.select("win", *columns).join(windows, "win")


def postings(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The positional index: one row per occurrence of a term that the bit set ``wanted`` lets pass."""
    packed_bits = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(packed_bits).astype(bool)
        for batch in batches:
            lists = batch.column("_terms")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero(passes[flat & (len(passes) - 1)] & (flat != 0))
            take = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at]), batch.column("_k1").take(take), batch.column("_k2").take(take), pa.array((at - begin[at]).astype(np.int32))],
                names=["term", "_k1", "_k2", "pos"],
            )

    return map_arrow(rows.select("_k1", "_k2", "_terms"), run, "term long, _k1 long, _k2 long, pos int")


def _candidates(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """Places where the looked-up terms of a window stand together, with how far they are off."""
    anchors = [f"{c}{i}" for i in range(1, ANCHORS) for c in "to"]
    found = index.join(windows, F.col("term") == F.col("t0")).select(
        "_k1", "_k2", "window", (F.col("pos") - F.col("o0")).alias("start"), F.lit(0).alias("off"), *anchors
    )
    width = slop + 1
    listed = index.select(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"), F.col("term").alias("_t"), F.col("pos").alias("_p"), F.floor(F.col("pos") / width).alias("_b"))
    for i in range(1, ANCHORS):
        expected = F.col("start") + F.col(f"o{i}")
        near = F.floor(expected / width)
        spread = found.withColumn("_near", F.explode(F.array(near - 1, near, near + 1)))
        on = (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")) & (F.col(f"t{i}") == F.col("_t")) & (F.col("_near") == F.col("_b"))
        off = F.abs(F.col("_p") - expected)
        # Of a term's places near the expected one, the closest counts.
        found = (
            spread.join(listed, on)
            .filter(off <= slop)
            .groupBy("_k1", "_k2", "window", "start", *[f"{c}{j}" for j in range(i + 1, ANCHORS) for c in "to"])
            .agg(F.min(F.greatest("off", off)).alias("off"))
        )
    return found.select("_k1", "_k2", "window", "start", "off")


def _matches(terms: np.ndarray, places: list[dict]) -> list[dict]:
    """Merged spans of the windows of each item at the places, exact ones, or else proximity ones."""
    exact: dict[str, set[tuple[int, int]]] = {}
    near: dict[str, set[tuple[int, int]]] = {}
    for p in places:
        window, start = p["win"], p["start"]
        same = p["off"] == 0 and start >= 0 and terms[start : start + len(window)].tolist() == window
        for item in p["items"]:
            (exact if same else near).setdefault(item, set()).add((max(0, start), min(len(terms), start + len(window))))
    out = []
    for found, is_exact in ((exact, True), (near, False)):
        for item in sorted(found):
            if not is_exact and item in exact:
                continue
            begin = until = None
            for a, b in sorted(found[item]):  # one span for windows that overlap or touch
                if until is not None and a <= until:
                    until = max(until, b)
                    continue
                if until is not None:
                    out.append({"item": item, "start": begin, "end": until, "exact": is_exact})
                begin, until = a, b
            out.append({"item": item, "start": begin, "end": until, "exact": is_exact})
    return out


def _verified(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every document with its matches: candidates compared word by word."""
    grouped = candidates.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("win", "items", "start", "off")).alias("_places"))
    names = ["doc_id", "_k1", "_k2", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                terms, places = batch.column("_terms"), batch.column("_places")
                hits = [_matches(terms[k].values.to_numpy(zero_copy_only=False), places[k].as_py()) if places[k].is_valid else [] for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hits, pa.list_(_HIT))], names=[*names, "hits"])

    joined = rows.join(grouped, ["_k1", "_k2"], "left").select(*names, F.when(F.col("_places").isNotNull(), F.col("_terms")).alias("_terms"), "_places")
    return map_arrow(joined, run, f"doc_id long, _k1 long, _k2 long, n_words long, hits {_HIT_SQL}")


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = SLOP,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, row key, ``n_words`` and ``hits``.

    A hit is (item, start, end, exact): word positions, end exclusive, of merged
    windows of an item. Proximity hits are given for items without an exact one.
    Null and empty texts have no words and no hits; null items are ignored; an
    item shorter than the window is one window; copies of a row get equal
    results; an id that is no number is null; texts of any length are read whole; an empty benchmark
    gives rows without hits, an empty table no rows; other columns of either table are not kept,
    so no names clash.
    """
    texts = benchmark.select(F.col(f"`{item_column}`").cast("string").alias("item"), F.col(f"`{item_text_column}`").alias("_text"))
    items = materialize(term_rows(texts.filter(F.col("item").isNotNull() & F.col("_text").isNotNull())), "items")
    narrow = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("_text"))
    keyed = row_key(narrow, "doc_id", "_text").select("doc_id", "_k1", "_k2", "_text")
    rows = materialize(term_rows(keyed, bit_set(items.select(F.explode("_terms").alias("term")))), "terms")

    counts = rows.select(F.explode("_terms").alias("term")).filter("term <> 0").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts")  # so that a join can split a term of very many windows
    windows = materialize(looked_up(test_windows(items, window), counts).withColumn("window", F.xxhash64("win")), "windows")
    wanted = windows.select(F.explode(F.array(*[f"t{i}" for i in range(ANCHORS)])).alias("term"))
    index = materialize(postings(rows, bit_set(wanted)), "postings")
    lookups = windows.select("window", *[f"{c}{i}" for i in range(ANCHORS) for c in "to"])
    places = _candidates(index, lookups, slop).join(windows.select("window", "win", "items"), "window")
    return _verified(rows, places)


def digest(matches: DataFrame, *keys: str) -> DataFrame:
    """Per document: words hit by exact matches, and the items that occur."""
    exact = F.filter("hits", lambda h: h["exact"])
    spans = F.array_sort(F.transform(exact, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    covered = F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["until"]))).alias("n"),
            F.greatest(a["until"], s["end"]).alias("until"),
        ),
        lambda a: a["n"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.transform(exact, lambda h: h["item"])))
    near = F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: ~h["exact"]), lambda h: h["item"])))
    return matches.select(
        *keys,
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        near.cast("long").alias("n_near_items"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no word is hit; a whole item shorter than a window is a hit too.

    Null and empty texts stay. Rows go by id and text, so copies of a row go together and a
    row that repeats an id with another text is judged by its own. Columns of any name are kept as they are.
    A text of any length is read whole. An empty table stays empty, and with an empty benchmark all rows stay.
    """
    hit = digest(find_matches(docs, benchmark), "_k1", "_k2").filter("contaminated")
    return packed(docs).join(hit.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_anti").select("_row.*")
