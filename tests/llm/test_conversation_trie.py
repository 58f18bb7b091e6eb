import hashlib
import random
import re
import zlib

import pytest

from loomspan.llm import conversation_trie as trie
from loomspan.llm.numbering import numbered

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The contract's trie by plain loops over whole prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest())
    own = {c: [(r, t) for _, r, t in sorted(turns, key=key)] for c, turns in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        todo, found = [node], []
        while todo:
            found.append(todo.pop())
            todo += children.get(found[-1], [])
        return found

    out = []
    for node, of in members.items():
        tree = below(node)
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in tree if n)
        ends = ",".join(str(c) for c in sorted(of) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children.get(node, [])), sum(not children.get(n) for n in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = trie.digest(*trie.prefix_trie(*trie.rebuilt(trie.turns_of(docs))), **more).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got), key=str)


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(0, longest)):
            rows.append((c, t, rng.choice("ua"), rng.choice(["x y", "x  y\n", "", "z"])))
    return rows


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 60, 6), (2, 30, 25)])
def test_equals_loops_over_prefixes(spark, seed, n, longest):
    rows = conversations(seed, n, longest)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(20, 0, "u", "a"), (20, 1, None, None), (21, None, "u", "late"), (21, 5, "u", None), (21, 5, "u", None), (None, 0, "u", "nobody's"), (None, None, None, None)]
    rows += [(-3, 0, "u", "a"), (-3, -1, "u", "b"), (0, 2, "é", "ñ  ü"), (22, 3, "u", "tie b"), (22, 3, "u", "tie a"), (7, None, None, None)]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(3)]  # copies, some of them turnless in part
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_slices_of_long_conversations(spark, monkeypatch):
    """Conversations that take several slices and blocks, and ids that take several pieces."""
    monkeypatch.setattr(trie, "SLICE", 4)
    rows = [(c, t, "u", f"t{t % 5}") for c in (1, 2, 3, 40) for t in range(37 if c != 3 else 20)]
    rows += [(c, 0, "u", "one") for c in range(200, 230)] + conversations(5, 12, 30)
    assert run(spark, rows, together=3) == brute(rows)


def test_numbering_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, o int, i int").repartition(7)
    got = numbered(frame, ["g"], ["o", "i"]).collect()
    want = {}
    for g in "ab":
        for place, (_, o, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[i] = place
    assert {r.i: r.place for r in got} == want
