"""Byte-level BPE as a streaming transducer, and its inverse.

The transducer reads bytes and keeps, for every position still open, the last
token of the encoding of the bytes up to it. A token follows another in a BPE
encoding exactly if merging the two alone leaves them apart, so the last token
at each position is found from the positions where it may have begun. What can
still change is bounded: a token that is not yet complete began at most
``lookahead`` bytes ago, that is the longest token less one byte. Once the ways
back from all open positions meet, everything before the meeting point is
stable, is emitted and forgotten, so memory doesn't depend on the text.

Decoding is a state machine over bytes: ids become bytes, complete characters
become text, and an incomplete character's bytes (three at most) are the state.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import map_arrow, text_or_empty

#: The pattern that splits text before merging.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
#: Characters of a text split at a time, bytes fed at a time, rows of an output batch.
SLICE, FEED, ROWS = 1 << 16, 1 << 10, 256
#: Bytes of a run up to which it is fed whole.
IN_VIEW = 256
#: Pieces whose encoding a worker remembers, and their longest size in characters.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Lengths(dict):
    """Last three bytes (fewer at a run's beginning) -> sizes of the tokens that may end in them, longest first; remembers up to a bound."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        super().__init__()
        self.of: dict[bytes, set[int]] = {}
        for token in tokens:
            self.of.setdefault(token[-3:], set()).add(len(token))

    def __missing__(self, end: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        sizes = set().union(*[self.of.get(end[i:], ()) for i in range(len(end))])
        found = self[end] = tuple(sorted(sizes, reverse=True))
        return found


class Merges:
    """Tables derived from a merge list: tokens by their bytes, and which tokens may stand together."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            self.rank_of[left, right] = rank
            self.parts.setdefault(vocab[a + b], (left, right, rank))
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.longest = max((len(self.bytes_of[t]) for t in self.parts), default=1)
        self.reach = [1] * 256  # the longest token that ends in a byte
        for t in vocab.values():
            end = self.bytes_of[t][-1]
            self.reach[end] = max(self.reach[end], len(self.bytes_of[t]))
        self.token_of = {self.bytes_of[t]: t for t in vocab.values()}.get
        self.lengths = Lengths(self.bytes_of[t] for t in vocab.values())
        self._apart: dict[int, bool] = {}
        self.known = self._apart.get

    @property
    def lookahead(self) -> int:
        """Bytes beyond a position that can still change which tokens reach it."""
        return self.longest - 1

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens ``a`` and ``b`` gives back just these two.

        Undo merges from the latest on, on whichever side has it, and ask each
        time whether the two tokens now facing each other would have merged
        before. At equal rank the merge further left comes first.
        """
        x, y = a, b
        limit_left = limit_right = 1 << 60
        apart = True
        while True:
            rank = self.rank_of.get((x, y))
            if rank is not None and rank < limit_left and rank <= limit_right:
                apart = False
                break
            left, right = self.parts.get(x), self.parts.get(y)
            if left is None and right is None:
                break
            if right is None or (left is not None and left[2] > right[2]):
                x, limit_left = left[1], left[2]
            else:
                y, limit_right = right[0], right[2]
        if len(self._apart) > 500_000:
            self._apart.clear()
        self._apart[a << 20 | b] = apart
        return apart


class Transducer:
    """Bytes in, tokens out, for one run of bytes: ``feed`` pieces of it, then ``finish``.

    The last token of the encoding up to a position is the one token that ends
    there and may follow the last token where it begins. It is looked for when
    asked for, longest first, and then remembered.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.data = b""
        self.known: dict[int, tuple[int, int]] = {0: (-1, 0)}  # position -> last token, where it began

    def _last(self, at: int) -> tuple[int, int]:
        """Looked up, or found with a stack of the positions that wait for an earlier one."""
        found = self.known.get(at)
        if found is not None:
            return found
        data, token_of, known, apart, reach = self.data, self.merges.token_of, self.merges.known, self.merges.apart, self.merges.reach
        here, begin, waiting = at, max(0, at - reach[data[at - 1]]), []
        while True:
            if begin == here:
                raise ValueError("the vocabulary lacks a byte")
            token = token_of(data[begin:here])
            if token is not None:
                earlier = self.known.get(begin)
                if earlier is None:
                    waiting.append((here, begin))
                    here, begin = begin, max(0, begin - reach[data[begin - 1]])
                    continue
                before = earlier[0]
                fits = before < 0 or known(before << 20 | token)
                if fits is None:
                    fits = apart(before, token)
                if fits:
                    found = self.known[here] = (token, begin)
                    if not waiting:
                        return found
                    here, begin = waiting.pop()
                    continue
            begin += 1

    def feed(self, data: bytes) -> list[int]:
        """The tokens that are stable now: no token that is still to come begins before them."""
        self.data += data
        if len(self.data) <= self.merges.lookahead:
            return []  # a token still to come may begin at the first byte
        for at in range(max(self.known) + 1, len(self.data) + 1):
            self._last(at)
        live = set(range(len(self.data) - self.merges.lookahead, len(self.data) + 1))
        while len(live) > 1:
            furthest = max(live)
            live.discard(furthest)
            live.add(self.known[furthest][1])
        meeting = live.pop()
        out = self._back(meeting)
        if meeting:
            token = self.known[meeting][0]
            self.data = self.data[meeting:]
            self.known = {p - meeting: (t, b - meeting) for p, (t, b) in self.known.items() if p > meeting}
            self.known[0] = (token, 0)
        return out

    def _back(self, at: int) -> list[int]:
        out = []
        while at:
            token, at = self._last(at)
            out.append(token)
        out.reverse()
        return out

    def finish(self) -> list[int]:
        """The run is over, so all its tokens are stable."""
        return self._back(len(self.data))


def run_in_view(merges: Merges, data: bytes) -> list[int]:
    """The tokens of a run that is fed whole and ends: what ``feed`` and ``finish`` give, by the same search from its end.

    Most runs are a word, so positions are places of lists and no machine is made for them.
    """
    token_of, known, apart, lengths = merges.token_of, merges.known, merges.apart, merges.lengths
    here = len(data)
    if not here:
        return []
    last, begun, waiting = [-1, *[-2] * here], [0] * (here + 1), []
    sizes, settled = iter(lengths[data[-3:]]), False
    while not settled:
        for size in sizes:
            begin = here - size
            if begin < 0:
                continue
            token = token_of(data[begin:here])
            if token is None:
                continue
            before = last[begin]
            if before == -2:
                waiting.append((here, begin, token, sizes))
                here, sizes = begin, iter(lengths[data[max(0, begin - 3) : begin]])
                break
            fits = before < 0 or known(before << 20 | token)
            if fits is None:
                fits = apart(before, token)
            while fits:
                last[here], begun[here] = token, begin
                if not waiting:
                    settled = True
                    break
                here, begin, token, sizes = waiting.pop()
                before = last[begin]
                fits = known(before << 20 | token)
                if fits is None:
                    fits = apart(before, token)
            break  # go on with the sizes of the position that is looked at now
        else:
            raise ValueError("the vocabulary lacks a byte")
    here = len(data)
    out = []
    while here:
        out.append(last[here])
        here = begun[here]
    out.reverse()
    return out


class Pieces(dict):
    """Piece of text -> ids, as the bytes of 32-bit numbers. Short pieces are remembered, in two generations of bounded size."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self._encode(piece)).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _encode(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        if len(data) <= IN_VIEW:
            return run_in_view(self.merges, data)
        machine, out = Transducer(self.merges), []
        for i in range(0, len(data), FEED):
            out += machine.feed(data[i : i + FEED])
        return out + machine.finish()


class Tokenizer:
    """Encode and decode whole texts with the tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.pieces = Pieces(self.merges)
        self.split = regex.compile(PATTERN)
        ids = self.merges.bytes_of
        self.table = [ids.get(i, b"") for i in range(max(ids) + 1)]

    def _runs(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text, a slice at a time. The last two pieces of a slice wait for what follows."""
        at, size = 0, SLICE
        while at < len(text):
            found = self.split.findall(text, at, min(at + size, len(text)))
            if at + size < len(text):
                kept = found[:-2]
                if not kept:
                    size *= 2  # a piece as long as the slice
                    continue
                found = kept
            yield found
            at, size = at + sum(map(len, found)), SLICE

    def encode(self, text: str) -> array:
        """Ids of a text; special tokens in it are recognised first."""
        out, at = array("i"), 0
        for m in chain(self.merges.special_pattern.finditer(text) if "<|" in text else (), (None,)):
            part = text[at : m.start() if m else len(text)] if at or m else text
            for run in self._runs(part):
                out.frombytes(b"".join(map(self.pieces.__getitem__, run)))
            if m:
                out.append(self.merges.special[m[0]])
                at = m.end()
        return out

    def decode(self, ids: list[int]) -> str:
        machine = TextMachine(self.table)
        return "".join([machine.feed(ids[i : i + SLICE]) for i in range(0, len(ids), SLICE)]) + machine.finish()


class TextMachine:
    """Ids in, text out. Its state is the bytes of a character not yet complete."""

    def __init__(self, table: list[bytes]) -> None:
        self.table = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a worker process."""
    return Tokenizer(path)


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text", to: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of each text.

    A null text counts as empty and gives an empty list. ``vocabulary`` is the
    path of the tokenizer's file, which every executor must be able to read.
    A column already named ``to`` is replaced. Repeated rows are encoded alike, a text of any length whole, and an
    empty table stays empty.
    """
    docs = docs.drop(to)
    names = [*docs.columns, to]
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                flat, ends = array("i"), [0]
                for text in batch.column(text_column).to_pylist():
                    flat.extend(tool.encode(text or ""))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=names)

    return map_arrow(docs, run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text its ids stand for; null ids give an empty text.

    Repeated rows are decoded alike, lists of any length whole; a column already named ``to`` is replaced, and an empty table stays empty.
    """
    encoded = encoded.drop(to)
    names = [*encoded.columns, to]
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                lists = batch.column(ids_column)
                flat = lists.flatten().to_pylist() if lists.null_count else lists.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum([0, *[n or 0 for n in lists.value_lengths().to_pylist()]]).tolist()
                texts = [tool.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return map_arrow(encoded, run, schema)


def round_trip(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Per row: id, number of tokens, and digests of its ids and of the decoded text; the ids too if asked for.

    A null text counts as empty: no tokens. Repeated rows are encoded alike, null ids stay
    null, other columns are not kept (so none can clash), and an empty table gives an empty
    result. A text of any length and a piece of any length are encoded whole, in memory that
    beyond the text and its ids doesn't grow with them.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                flat, ends, texts = array("i"), [0], []
                for text in batch.column("text").to_pylist():
                    ids = tool.encode(text)
                    flat.extend(ids)
                    ends.append(len(flat))
                    texts.append(tool.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    # Both ways in one worker: a second one would hold the tables and the remembered pieces once more.
    return map_arrow(narrow, run, schema).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )
