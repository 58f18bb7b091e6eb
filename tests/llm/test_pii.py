import random
import re
from collections import Counter

import pytest

from loomspan.llm import pii


def brute(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_patterns_equal_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        alphabet = r.choice(["0123456789 -", "@.ab-", "+ -().5", "1.25", "a@b.c é"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert pii.pattern_spans(text) == brute(text), text


def test_patterns_are_linear_on_long_runs():
    assert pii.pattern_spans("a" * 300_000 + "1" * 300_000 + "@" + "+" * 1000) == []


def test_field_on_held_out_sentences(spark, field):
    rows = pii.labelled_table(spark, 300, seed=99).collect()
    found = field.label_lines([list(r.tokens) for r in rows])
    right = sum([pii.LABELS[x] for x in labels] == list(r.tags) for labels, r in zip(found, rows, strict=True))
    assert right >= 0.93 * len(rows)


#: Sentences whose patterns the labelled table doesn't have.
OTHERS = (
    "my name is {name} , I think", "this is to certify that Mr. {surname} paid", "Dear {name} , we thank you", "the form was signed by Dr. {surname} last week", "me llamo {name} .",
    "yesterday {given} left early", "write to my friend {given} soon", "Sehr geehrter Herr {surname} , danke", "we live at {address} since May", "the parcel went to {address} again", "she moved to {address} .",
    "vive en la {address} ahora", "send mail to {email} please", "questions ? {email} !", "just call {phone} any time", "my phone : {phone} , thanks", "charge the card {card} tomorrow",
    "visa {card} expired", "his ssn was {national} then", "the passport {national} is lost", "our number in the file : {national} .", "use the token {secret} here", "secret={secret} and more", "curl with key {secret} works",
    "the {Word} has {number} and {number} more", "all {word} {word} are {word} , {Word} too", "{Word} {word} {number} . {Word}", "{prose}", "{prose} {number} {word}", "{prose}",
)


def test_field_on_sentences_of_other_patterns(spark, field):
    rows = pii.labelled_table(spark, 900, seed=41, patterns=OTHERS).collect()
    right, wanted, given = Counter(), Counter(), Counter()
    for labels, r in zip(field.label_lines([list(r.tokens) for r in rows]), rows, strict=True):
        for label, tag in zip(labels, r.tags, strict=True):
            wanted[tag] += 1
            given[pii.LABELS[label]] += 1
            right[tag] += pii.LABELS[label] == tag
    recall = {k: right[k] / wanted[k] for k in pii.LABELS}
    precision = {k: right[k] / max(1, given[k]) for k in pii.LABELS}
    print({k: (round(recall[k], 3), round(precision[k], 3)) for k in pii.LABELS})
    assert min(recall.values()) >= 0.75 and min(precision.values()) >= 0.85, (recall, precision)
    assert recall["O"] >= 0.98


def test_every_token_is_labelled_and_edges_are_right(field):
    cases = {
        "My name is Anna Schmidt and I live at Elm Street": {("m_name", "Anna Schmidt"), ("m_address", "Elm Street")},
        'thing token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### to': {("m_secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")},
        "password=0123456789abcdef0123456789abcdef now": {("m_secret", "0123456789abcdef0123456789abcdef")},
        "Her SSN is 123-45-6789.": {("m_national", "123-45-6789")},
        "passport number X1234567 was lost": {("m_national", "X1234567")},
        "of of of to to to to to to to to to to to to": set(),
        "Anna": set(),
    }
    for text, want in cases.items():
        for around in ("", "the thing was done. ", "word " * 300):
            whole = f"{around}{text}\n{around}"
            got = pii.model_spans([whole], [pii.pattern_spans(whole)], field)[0]
            if text != "Anna":
                assert {(k, whole[a:b]) for k, a, b in got} == want, (whole[-80:], got)


def test_order_of_the_table_does_not_matter(spark, field):
    table = pii.labelled_table(spark)
    again = pii.train(table.repartition(7), at_most=200, rounds=3)
    first = pii.train(table, at_most=200, rounds=3)
    assert again.names == first.names and (again.weights == first.weights).all()


def test_viterbi_equals_brute_force(field):
    from itertools import product

    import numpy as np

    r = np.random.default_rng(0)
    emit = r.normal(size=(8, 4, len(pii.LABELS)))
    lengths = np.array([1, 2, 3, 4] * 2)
    labels = field._viterbi(emit, lengths)
    for i, n in enumerate(lengths):
        score = lambda p: sum(emit[i, t, x] for t, x in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(len(pii.LABELS)), repeat=int(n)), key=score)
        assert tuple(labels[i, :n]) == best


def test_finds_and_leaves_alone(field):
    texts = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" in it", "plain words, and version 2.0 of 1999.", "mail me at jo@ex.org", "write jane (at) host (dot) org now"]
    base = [pii.pattern_spans(t) for t in texts]
    more = pii.model_spans(texts, base, field)
    assert [texts[0][a:b] for _, a, b in more[0]] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert base[1] == more[1] == [] and base[2] == [("email", 11, 20)] and more[2] == []
    assert more[3] and all(k == "m_email" for k, _, _ in more[3])


def test_awkward_rows(awkward, empty, field):
    found = pii.find_pii(awkward, field)
    assert found.count() == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.KINDS] == brute(texts[r.doc_id] or "")
    assert pii.digest(pii.find_pii(empty, field)).collect() == []
