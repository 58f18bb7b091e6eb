import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from loomspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = [chr(c) for c in range(0x250)] + list("\x85 ᠎ 　﻿​中文😀́אב٣²Ⅻ")


@pytest.fixture(scope="module")
def tools():
    return bpe.Tokenizer(PATH), Library.from_file(PATH)


def test_equals_the_library_on_random_texts(tools):
    own, library = tools
    r = random.Random(11)
    for _ in range(1500):
        letters = r.choice([POOL, "ab", "the ing", " \n\t", "'sreve tlld ", "0123", "<|endoftext|> x"])
        text = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 20, 150])))
        if r.random() < 0.1:
            text = f"{text}<|endoftext|>{text}"
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_runs_and_slices(tools):
    own, library = tools
    for text in ("a" * 150_000, " " * 70_000 + "x", "word " * 40_000, "é" * 70_000):
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_pieces_that_hardly_merge(tools):
    own, library = tools
    r = random.Random(5)
    texts = ["\x01" * 1000, "xqzj" * 255, "\u1e9e\u0250" * 200, "\x01" * 5000, "q" * 1023 + "\u0250"]
    for n in [*range(1, 4096, 173), *range(900, 1030, 13), 127, 128, 129, 1023, 1024, 1025, 2048]:
        texts.append("".join(r.choice(["\x01\x02\x7f", "xqzjvkw", "\u1e9e\u0250\u4e2d\u05d0", "\u4e2d\u6587\u0439"][n % 4]) for _ in range(n)))
    for text in texts:
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_streaming_holds_a_bounded_state(tools):
    own, _ = tools
    machine, most, out = bpe.Transducer(own.merges), 0, []
    data = b"thequickbrownfox" * 4000
    for i in range(0, len(data), 1000):
        out += machine.feed(data[i : i + 1000])
        most = max(most, len(machine.data), len(machine.known))
    assert out + machine.finish() == list(own.pieces._encode(data.decode())) and most < 1000 + 4 * own.merges.lookahead


def test_decoding_keeps_broken_characters(tools):
    own, library = tools
    ids = library.encode("😀é", add_special_tokens=False).ids
    for part in (ids[:1], ids[1:], ids[::-1]):
        assert own.decode(part) == library.decode(part, skip_special_tokens=False)


def test_awkward_rows_round_trip(awkward, empty):
    encoded = bpe.encode(awkward, PATH)
    assert encoded.columns == [*awkward.columns, "ids"]
    back = bpe.decode(encoded, PATH).collect()
    assert len(back) == awkward.count() and all(r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip(awkward, PATH).filter("n_tokens = 0").count() == awkward.filter("coalesce(text, '') = ''").count()
    assert bpe.round_trip(empty, PATH).collect() == []


def test_runs_in_view_equal_the_machine(tools):
    """Short runs are searched without a machine, and give what it gives."""
    own, library = tools
    r = random.Random(23)
    for n in [1, 2, 3, 9, 40, 127, 128, 255, 256]:
        for letters in ("etaoinshr", "\x01\x02\x7f", "é\u1e9e中", " \n"):
            data = "".join(r.choice(letters) for _ in range(n)).encode()[:256]
            machine = bpe.Transducer(own.merges)
            assert bpe.run_in_view(own.merges, data) == machine.feed(data) + machine.finish()


def test_round_trip_takes_one_python_step(awkward):
    plan = bpe.round_trip(awkward, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
