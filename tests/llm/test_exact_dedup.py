import hashlib
import random

from pyspark.sql import functions as F

from loomspan.llm.common import lower_ascii
from loomspan.llm.exact_dedup import chunks, exact_duplicates


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[lowered(t)]), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted((tuple(r) for r in exact_duplicates(docs, **more).collect()), key=str)


def test_matches_brute_force(awkward):
    assert run(awkward) == expected([(r.doc_id, r.text) for r in awkward.collect()])


def test_colliding_hashes_are_told_apart(awkward):
    """A hash of eight values makes nearly all chunks collide; the result must not change."""
    weak = lambda c: F.pmod(F.length(c), F.lit(8)).cast("long")
    assert run(awkward, hash_chunk=weak) == expected([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty_table(empty):
    assert run(empty) == []


def test_chunks_rebuild_the_text_and_move_with_it(spark):
    body = "".join(f"sentence {i * i % 1013} is here and more there.\n" for i in range(900))
    rows = spark.createDataFrame([("a", body), ("b", "shifted start " + body)], "k string, t string")
    got = {r.k: (r.t, r.c) for r in rows.withColumn("c", chunks(F.col("t"))).collect()}
    for text, parts in got.values():
        assert "".join(parts) == text and max(map(len, parts)) <= 2048
    shared = set(got["a"][1]) & set(got["b"][1])
    assert len(shared) > 0.8 * len(set(got["a"][1]))


def test_cuts_follow_the_content_in_any_script(spark):
    r = random.Random(9)
    scripts = {
        "chinese": "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000)),
        "arabic": " ".join("".join(chr(r.randrange(0x620, 0x64A)) for _ in range(r.randint(2, 8))) for _ in range(9000)),
        "cyrillic": " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(r.randint(2, 8))) for _ in range(9000)),
        "runs": "a" * 20_000 + "ab" * 10_000 + "nd, " * 5000 + "".join(chr(97 + i * i * 7 % 23 % 19) for i in range(9000)),
        "minified": "".join(r.choice("abcdefghijklmnopqrstuvwxyz(){};=.,0123456789") for _ in range(60_000)),
    }
    rows = spark.createDataFrame([(k, i, shift + t) for k, t in scripts.items() for i, shift in enumerate(("", "x"))], "k string, i int, t string")
    got = {(r.k, r.i): (r.t, r.c) for r in rows.withColumn("c", chunks(F.col("t"))).collect()}
    for k in scripts:
        (_, plain), (text, shifted) = got[k, 0], got[k, 1]
        assert "".join(shifted) == text
        if k != "runs":  # of which few distinct chunks come
            assert len(plain) > 20 and len(set(plain) & set(shifted)) > 0.9 * len(set(plain)), (k, len(plain))


def test_lower_ascii_only(spark):
    rows = spark.createDataFrame([("ABC xyz",), ("ÀBC ß İ",)], "t string")
    assert [r[0] for r in rows.select(lower_ascii(F.col("t"))).collect()] == ["abc xyz", "Àbc ß İ"]
