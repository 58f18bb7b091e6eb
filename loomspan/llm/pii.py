"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find e-mail and IP addresses, card and phone numbers as written by
the rules. The field labels tokens by their shape and their neighbours' shape, and
so also finds what no pattern lists: keys and passwords, addresses written as
"name (at) host (dot) org", phone numbers without a plus sign, names, street addresses,
national numbers. It labels every token of a text. It is trained on
the driver from a small labelled table and decoded by Viterbi, many sequences at
a time in numpy.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow, text_or_empty

#: The kinds of the patterns, in the order of their listing.
KINDS = ("email", "ip", "card", "phone")
#: Labels of the field; all but the first give spans of the kind "m_" and the label.
LABELS = ("O", "email", "phone", "card", "secret", "name", "address", "national")
#: Tokens on either side whose features count for a token.
REACH = 2
#: A sentence of a line is a sequence from so many tokens on; at so many it is parted even without a sentence's end.
SHORTEST, LONGEST = 8, 128
#: Rows of an output batch, and sequences decoded at a time.
ROWS, SEQUENCES = 256, 2048
#: Tokens a worker remembers, and their longest size in characters.
REMEMBERED, REMEMBERED_LENGTH = 60_000, 48

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long runs of letters cost no second look."""
    floor = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- the labelled table

#: Sentence patterns of the labelled table; {label} stands for an example of it.
_SENTENCES = (
    "please write to {email} before noon", "reach me at {email} or {email}", "contact : {email} .",
    "my address is {email} thanks", "mail {email} for details", "{email}", "senda a {email} para más",
    "call {phone} after lunch", "phone {phone} today", "tel {phone}", "his number is {phone} , she said",
    "ring {phone} or {phone} now", "{phone}", "fax : {phone} office", "téléphone {phone} le matin",
    "card {card} was charged", "paid with {card} yesterday", "the card number {card} expires", "{card}", "{word} {word} {card} {word}",
    "password={secret} for login", "the {secret} leaked in", "token = {secret} end", "export {secret} then run",
    "api key {secret} was used", "{secret}", "key: {secret} ok", "set password= {secret} now", "text {secret} more text",
    "my name is {name} and I came late", "his name was {name} .", "the patient , {name} , was seen", "Mr. {surname} called {word}",
    "we met Mrs. {surname} at noon", "Dr. {name} signed the form", "Signed , {name}", "Dear {name} , thanks", "Dear Ms. {surname} :",
    "Name: {name}", "yours sincerely , {name}", "contact person : {name}", "me llamo {name} y vivo aquí", "el señor {surname} vino",
    "Herr {surname} kam zu spät", "Frau {name} wohnt hier", "ich heiße {name} und komme", "je m'appelle {name} .", "Madame {surname} est là",
    "{word} {word} {given} {word} {word}", "then {given} said {word}", "{given} {word} {word} .", "the employee {name} left", "patient name : {name}",
    "I live at {address} in the town", "she lives at {address} .", "he lived in {address} for years", "ship it to {address} please",
    "Address: {address}", "our office is at {address} , second floor", "vivo en la {address} con ella", "er wohnt in der {address} hier",
    "j'habite {address} depuis", "{address}", "deliver to {address} {word}", "the house at {address} was sold",
    "ssn {national} on file", "social security number {national} .", "my ssn is {national} and", "passport {national} issued",
    "passport no. {national} expires", "DNI {national} válido", "national insurance number {national}", "{national}", "tax id : {national}",
    "her passport number is {national} .", "Personalausweis {national} gültig", "id number : {national} {word}",
    "licensed under the terms , version {number} .", "chapter {number} begins on page {number}", "see {number} and {number}",
    "in {number} it was the best", "he said : yes", 'the "quoted" word', "it costs {number} or {number}", "at {number} we met",
    "{number}", "a = b + c", "ratio {number} : {number}", "version {number} of the tool = {number}", "the and of that with",
    "{number} people and {number} dogs", 'she called it "late" and left', "note : the token was lost", "by-nc {number} .",
    "row {number} | {number} | {number}", "10% of {number} items", "C++ and {number} others", "x={number} , y={number}",
    "{Word} {word} {word} {word} . {Word} {word} {word}", "{word} {word} {Word} {word} {word} {Word} {word}", "{Word} , {word} {Word} . {Word} {word} ,",
    "{WORD} {WORD} {WORD} {WORD} {WORD}", "{WORD} {number} {WORD} {WORD} .", "{word} , {word} {word} , {word} {word} .", "{Word} {Word} {word} {word}",
    "der {Word} und die {Word} {word} das {Word} .", "the {Word} {Word} of {Word} {word}", "{word} {word} {word} {word} {word} {word}", "{Word} .", "{word}",
    "All rights reserved .", "the GNU General Public License , version {number} .", "under the Apache License , Version {number} .", "Creative Commons Attribution",
    "{word}%%% {Word}$$$ {word}&&& {number}### {word}", "{Word}!! {WORD}!! {word}!! , {word}", "the name of the {Word} is {word}", "the street was {word}", "a number of {Word} {word}",
    *["{prose}"] * 50, "this license name is {word} {word}", "her name is {word} to me", "they live at the {word} of {word}", "the contact was {word} , {word}", "the passport was {word}",
)

#: Common given names, and words for streets as languages write them, behind and ahead of the street's name.
_GIVEN = frozenset(
    """Alice Andrea Anna Antonio Carlos Carmen Catherine Charles Claire Claudia Daniel David Diego Elena Elizabeth Emily Emma Eva Fernando Francisco
    Friedrich George Hans Heinrich Helen Henry Isabel James Jane Javier Jean Johann John José Juan Julia Karl Klaus Laura Louis Lucas Lucía Luis Maria
    María Marie Martin Mary Matthew Michael Michel Miguel Nicolas Olivia Pablo Paul Pedro Peter Philippe Pierre Rachel Richard Robert Sarah Sofia Sophie
    Stefan Susan Thomas Ursula William Wolfgang""".split()
)
_STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "boulevard", "square", "court", "terrace")
_STREETS_AHEAD = ("calle", "avenida", "plaza", "paseo", "rue", "place")
_GERMAN_STREETS = ("straße", "strasse", "weg", "gasse", "platz")
#: Parts of made-up words.
_PARTS = "the an on er in th es ing tion ent ar le de ou la ch pre ed ie ung en el os ción mente ré ñu ü".split()
#: Placeholders that stand for an example of another label.
_TAGS = {"surname": "name", "given": "name"}


def _example(kind: str, r: random.Random) -> str:
    def letters(a: int, b: int) -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(r.choice(_PARTS) for _ in range(r.randint(1, 4)))

    def capital() -> str:
        return letters(3, 9).capitalize() if r.random() < 0.5 else word().capitalize()

    def big(n: int) -> str:
        return letters(n, n).upper()

    if kind == "prose":
        return " ".join(_prose(r, word))
    if kind in ("word", "Word", "WORD"):
        return {"word": word(), "Word": word().capitalize(), "WORD": word().upper()}[kind]
    if kind == "surname":
        return r.choice([capital(), capital(), f"{capital()}-{capital()}"])
    if kind == "given":
        return f"{r.choice(sorted(_GIVEN))} {capital()}"
    if kind == "name":
        first = r.choice(sorted(_GIVEN)) if r.random() < 0.6 else capital()
        return r.choice([f"{first} {capital()}", f"{first} {capital()}", f"{first} {big(1)}. {capital()}", f"{first} {capital()} {capital()}"])
    if kind == "address":
        n, street, ahead = r.randint(1, 250), r.choice(_STREETS).capitalize(), r.choice(_STREETS_AHEAD)
        ahead = ahead if r.random() < 0.5 else ahead.capitalize()
        forms = [f"{n} {capital()} {street}", f"{capital()} {street}", f"{n} {capital()} {capital()} {street}", f"{ahead} {capital()} {n}"]
        forms += [f"{ahead} de {capital()} {n}", f"{n} {ahead} {capital()}", f"{capital()}{r.choice(_GERMAN_STREETS)} {n}"]
        return r.choice(forms)
    if kind == "national":
        social = f"{digits(3)}-{digits(2)}-{digits(4)}"
        forms = [social, social, f"{big(1)}{digits(r.randint(7, 8))}", f"{digits(8)}{big(1)}", f"{big(2)}{digits(6)}{big(1)}", f"{big(1)}{digits(2)}{big(1)}{digits(5)}"]
        return r.choice(forms)
    if kind == "email":
        host = f"{letters(3, 8)}{r.choice(['', '7', '.example'])}"
        if r.random() < 0.5:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]")])
            return f"{letters(3, 7)} {at} {host} {dot} {r.choice(['com', 'org', 'net'])}"
        return f"{letters(2, 8)}{r.choice(['', '.', '_'])}{r.choice(['', digits(2)])}@{host}.{r.choice(['com', 'org', 'es'])}"
    if kind == "phone":
        form = r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+{d} {a} {b} {c}", "+{d} ({a}) {b}-{c}"])
        return form.format(a=digits(3), b=digits(3), c=digits(4), d=digits(r.randint(1, 2)))
    if kind == "card":
        return r.choice([digits(16), "-".join(digits(4) for _ in range(4)), " ".join(digits(4) for _ in range(4))])
    if kind == "secret":
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 20, 32, 40])))
        key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        return r.choice([hexed, f'"{hexed}"', f'"{hexed.upper()}"', f"AKIA{key}", f"sk-{key}{hexed[:8]}", f"password={hexed}", f"ghp_{hexed}"])
    return r.choice([digits(1), digits(2), digits(4), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.", f"19{digits(2)}",
                     f"{digits(2)}:{digits(2)}", f"{digits(3)},{digits(3)}", f"${digits(2)}", f"{digits(1)}th", f"v{digits(1)}", digits(3),
                     f"{digits(2)}%", f"{digits(5)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}-{digits(1)}"])


def _prose(r: random.Random, word: Callable[[], str]) -> Iterator[str]:
    """Text without personal data: common words, made-up ones, repeated ones, sentences, odd marks, capitals."""
    common = sorted(w for w in _CUES if w.isalpha())
    marks = r.choice([("",), ("",), ("", "", "", "", ",", "."), ("%%%", "$$$", "###", "***", "&&&", ",%%%"), ("!!", ",!!"), ("", "", "?", ":", ".")])
    write = r.choice([str, str, str, str.capitalize, str.upper])
    capitals = r.choice([0, 0.1, 0.4])
    same = r.choice([r.choice(common), r.choice(("to", "in", "at", "la", "der", "de", "st", "no", "my")), r.choice("AOÉÖ"), word()]) if r.random() < 0.5 else None
    end = True
    for i in range(r.randint(3, 25 if same else 14)):
        w = same if same and i > 1 else (r.choice(common) if r.random() < 0.5 else word())
        w = w.capitalize() if end or r.random() < capitals else w
        mark = r.choice(marks)
        end = mark in (".", "?") and r.random() < 0.9
        yield write(w) + mark


def labelled_table(spark: SparkSession, rows: int = 1800, seed: int = 7, patterns: tuple[str, ...] = _SENTENCES) -> DataFrame:
    """The built-in labelled table: ``tokens`` and ``tags`` of ``rows`` short sentences."""
    r, out = random.Random(seed), []
    for i in range(rows):
        tokens, tags = [], []
        for part in re.split(r"(\{\w+\})", patterns[i % len(patterns)]):
            kind = part[1:-1] if part.startswith("{") else "O"
            found = (_example(kind, r) if kind != "O" else part).split()
            if kind == "O" and found and tokens and found[0][0] in ".,:%$&#!" and r.random() < 0.7:
                tokens[-1] += found.pop(0)  # marks stand at the word before, as they do in texts
            elif kind != "O" and r.random() < 0.15:
                found[-1] += r.choice([".", ",", ";", "###", "!!"])
            tag = _TAGS.get(kind, kind)
            tokens += found
            tags += [tag if tag in LABELS else "O"] * len(found)
        if r.random() < 0.5:  # within a text, not alone on its line
            ahead = [_example("word", r) for _ in range(r.randint(1, 3))]
            ahead[-1] += r.choice(["", ".", ","])
            tokens, tags = ahead + tokens, ["O"] * len(ahead) + tags
        out.append((tokens, tags))
    return spark.createDataFrame(out, "tokens array<string>, tags array<string>")


# ---------------------------------------------------------------- features

#: Words that say what stands near.
_CUES = frozenset(
    """password passwd token secret key phone tel call fax card number email mail contact api (at) [at] (dot) [dot]
    name named my his her mr mrs ms dr prof dear signed sincerely patient employee señor señora don doña herr frau heiße llamo m'appelle madame
    monsieur live lives lived address at in to la der de wohnt vivo j'habite ssn social security passport dni national insurance tax id no personalausweis""".split()
).union(_STREETS, _STREETS_AHEAD)
#: Those of them that a full stop shortens.
_SHORTENED = frozenset("mr mrs ms dr prof no tel st rd ave".split())
_TRIGGER = re.compile(r"[0-9@=+\"]")
_EDGE = re.compile(r"^[^\w+(\[]+|[^\w)\]]+$")
_CAPITAL = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Features of places beyond a line's ends, and of a common word.
_BEYOND, _PLAIN = ("beyond",), ("plain",)


def features(token: str) -> tuple[str, ...]:
    """Names of a token's features: its word or shape, its runs, what it contains, and how it ends."""
    core = _EDGE.sub("", token)
    low = core.lower()
    after = token[-1] if token and not token[-1].isalnum() else ""
    end = (f"end={after if after in '.,:;!?' else 'other'}",) if after else ()
    if low in _CUES and (after not in (".", "!", "?") or low in _SHORTENED):
        return (f"cue={low}", "capital cue" if core[:1].isupper() else "cue", *end)
    if not core:
        return ("mark", *end)
    if not _TRIGGER.search(token):
        if core in _GIVEN:
            return ("given", "capital", *end)
        if core.isupper():
            return ("initial" if len(core) == 1 else "upper", *end)
        if core[0].isupper() and _CAPITAL.fullmatch(core):
            kind = "street" if low.endswith(_GERMAN_STREETS) and len(low) > 6 else "last" if after in (".", "!", "?") else "noun"
            return ("capital", kind, *end)
        return (*_PLAIN, *end) if core.isalpha() else ("odd", *end)
    shape = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", re.sub(r"[A-Z]", "X", core)))
    runs = re.sub(r"(.)\1*", lambda m: m[1] + (str(len(m[0])) if len(m[0]) < 5 else "+"), shape)
    n, d = len(core), sum(c.isdigit() for c in core)
    out = [f"shape={re.sub(r'(.)\1+', r'\1', shape)[:24]}", f"runs={runs[:24]}", f"size={min(n, 48) // 4}", f"digits={min(d, 20)}", f"length={min(n, 24)},{min(d, 24)}"]
    solid = re.sub(r"[^\w-].*|.*=\"?", "", core) if "=" in core else core
    mixed = bool(re.search(r"[0-9]", solid)) and bool(re.search(r"[A-Za-z]", solid))
    out.append(f"mixed={mixed},{len(solid) >= 16},{bool(re.fullmatch(r'[\w-]+', solid))}")
    out += [f"has={c}" for c in "@=+-.(:\"/%" if c in token]
    return (*out, *end)


class Field:
    """Weights of a linear-chain field over the features of tokens.

    A token's emission sums the weights of its own features and of those of the
    ``REACH`` tokens on either side; ``moves`` weighs one label after another. Tokens
    with the same features share a row of the table of sums.
    """

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves.astype(np.float32)  # weights: places x features x labels
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.row_of: dict[tuple[str, ...], int] = {}
        self.rows = np.zeros((2 * REACH + 1, 256, len(LABELS)), np.float32)
        self.beyond, self.plain = self._row(_BEYOND), self._row(_PLAIN)

    def _row(self, found: tuple[str, ...]) -> int:
        at = self.row_of.get(found)
        if at is None:
            at = self.row_of[found] = len(self.row_of)
            if at >= self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], 1)
            self.rows[:, at] = self.weights[:, [self.names[f] for f in found if f in self.names]].sum(1)
        return at

    def _token(self, token: str) -> int:
        at = self.known.get(token)
        if at is None:
            at = self._row(features(token))
            if len(token) <= REMEMBERED_LENGTH:
                self.known[token] = at
        return at

    def label_lines(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best labels of the tokens of each line."""
        if len(self.known) > REMEMBERED or len(self.row_of) > REMEMBERED:
            self._forget()
        gap, flat, begin = [self.beyond] * REACH, [self.beyond] * REACH, []
        for tokens in lines:
            begin.append(len(flat))
            flat += map(self._token, tokens)
            flat += gap
        ids = np.array(flat)
        n = len(ids) - 2 * REACH
        emit = np.zeros((len(ids), len(LABELS)), np.float32)
        for place in range(2 * REACH + 1):
            emit[REACH : REACH + n] += self.rows[place][ids[place : place + n]]
        starts, lengths = _sequences(lines, begin)
        labels = np.zeros(len(ids), np.int8)
        order = np.argsort(lengths, kind="stable")
        for k in range(0, len(order), SEQUENCES):
            part = order[k : k + SEQUENCES]
            size = lengths[part]
            at = starts[part][:, None] + np.minimum(np.arange(size[-1])[None], size[:, None] - 1)
            # Later places of shorter sequences repeat their last one, with the same label.
            labels[at] = self._viterbi(emit[at], size)
        return [labels[b : b + len(t)] for b, t in zip(begin, lines, strict=True)]

    def _viterbi(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many sequences of emissions at once; beyond a sequence's length its last label is repeated."""
        n, longest, k = emit.shape
        labels = np.zeros((n, longest), np.int8)
        score, back = emit[:, 0].copy(), np.zeros((longest, n, k), np.int8)
        for t in range(1, longest):
            ways = score[:, None, :] + self.moves.T[None]
            best = ways.argmax(2)
            new = np.take_along_axis(ways, best[..., None], 2)[..., 0] + emit[:, t]
            inside = (t < lengths)[:, None]
            back[t] = np.where(inside, best, np.arange(k))
            score = np.where(inside, new, score)
        at = score.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, 0, -1):
            labels[:, t] = at
            at = back[t][rows, at]
        labels[:, 0] = at
        return labels


def _sequences(lines: list[list[str]], begin: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where sequences begin, and their lengths: sentences of a line, parted every ``LONGEST`` tokens.

    Labels of a sequence depend on each other; a token's features reach over its ends.
    """
    starts, lengths = [], []
    for b, tokens in zip(begin, lines, strict=True):
        at = 0
        for i, t in enumerate(tokens):
            if i + 1 - at >= LONGEST or (i + 1 - at >= SHORTEST and t[-1] in ".!?") or i + 1 == len(tokens):
                starts.append(b + at)
                lengths.append(i + 1 - at)
                at = i + 1
    return np.array(starts, np.int64), np.array(lengths, np.int64)


def train(table: DataFrame, rounds: int = 100, rate: float = 0.3, decay: float = 2e-3, at_most: int = 5000) -> Field:
    """Fit the field to at most ``at_most`` labelled sentences, those of least hash, by gradient ascent on the likelihood."""
    ordered = table.orderBy(F.xxhash64("tokens", "tags"), "tokens", "tags").limit(at_most)
    data = sorted((r["tokens"], r["tags"]) for r in ordered.collect())
    data = [(t, g) for t, g in data if t]
    if not data:
        return Field({}, np.zeros((2 * REACH + 1, 0, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    k, n, longest = len(LABELS), len(data), max(len(t) for t, _ in data)
    number = {label: i for i, label in enumerate(LABELS)}
    # Tokens with the same features are one column; place 0 of the table of ids is beyond a line.
    kinds: dict[tuple[str, ...], int] = {_BEYOND: 0}
    ids, gold = np.zeros((n, longest + 2 * REACH), int), np.zeros((n, longest), int)
    for s, (tokens, tags) in enumerate(data):
        ids[s, REACH : REACH + len(tokens)] = [kinds.setdefault(features(t), len(kinds)) for t in tokens]
        gold[s, : len(tags)] = [number[x] for x in tags]
    names = {f: i for i, f in enumerate(sorted({f for found in kinds for f in found}))}
    has = np.zeros((len(kinds), len(names)))
    for found, row in kinds.items():
        has[row, [names[f] for f in found]] = 1
    lengths = np.array([len(t) for t, _ in data])
    mask = np.arange(longest)[None] < lengths[:, None]
    target = np.eye(k)[gold] * mask[..., None]
    pairs = mask[:, 1:].astype(float)
    target_moves = np.einsum("nti,ntj,nt->ij", np.eye(k)[gold[:, :-1]], np.eye(k)[gold[:, 1:]], pairs)
    weights, moves = np.zeros((2 * REACH + 1, len(names), k)), np.zeros((k, k))
    square_w, square_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    around = [ids[:, p : p + longest] for p in range(2 * REACH + 1)]
    for _ in range(rounds):
        emit = sum((has @ weights[p])[at] for p, at in enumerate(around))
        expected, expected_moves = _marginals(emit, moves, mask)
        rest = target - expected
        grad_w = -decay * n * weights / 10
        for p, at in enumerate(around):
            by_kind = np.stack([np.bincount(at.ravel(), rest[..., j].ravel(), len(kinds)) for j in range(k)], 1)
            grad_w[p] += has.T @ by_kind
        grad_m = target_moves - expected_moves - decay * n * moves / 10
        square_w += grad_w**2
        square_m += grad_m**2
        weights += rate * grad_w / np.sqrt(square_w)
        moves += rate * grad_m / np.sqrt(square_m)
    return Field(names, weights, moves)


def _marginals(emit: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels per token, and expected label pairs in all, by scaled forward and backward sums."""
    n, longest, k = emit.shape
    here, move = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves)
    ahead, behind, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((n, longest, 1))
    ahead[:, 0] = here[:, 0] / here[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        new = (ahead[:, t - 1] @ move) * here[:, t]
        scale[:, t] = new.sum(1, keepdims=True)
        ahead[:, t] = new / scale[:, t]
    for t in range(longest - 2, -1, -1):
        new = ((behind[:, t + 1] * here[:, t + 1]) @ move.T) / scale[:, t + 1]
        behind[:, t] = np.where(mask[:, t + 1, None], new, 1)
    expected = ahead * behind * mask[..., None]
    later = (here * behind / scale * mask[..., None])[:, 1:]
    return expected, np.tensordot(ahead[:, :-1], later, ((0, 1), (0, 1))) * move


# ---------------------------------------------------------------- the operator


_TOKEN = re.compile(r"\S+")
#: What stands before a secret within its token, as in password=...
_AHEAD = re.compile(r"[A-Za-z_]{2,}[\"']?[=:][\"']?")


def _trimmed(text: str, start: int, end: int, label: str) -> tuple[int, int]:
    """A span without the marks at its ends; a plus sign or a bracket may begin one, an equals sign may end a secret."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or (label == "secret" and text[end - 1] == "=")):
        end -= 1
    ahead = _AHEAD.match(text, start, end) if label == "secret" else None
    return (ahead.end() if ahead and ahead.end() < end else start), end


def model_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds to each text: those that overlap no pattern's span. Every token of a text is labelled."""
    places, lines = [], []
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if tokens := line.split():
                places.append((i, at, line))
                lines.append(tokens)
            at += len(line) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, begin, line), labels in zip(places, field.label_lines(lines) if lines else (), strict=True):
        if not labels.any():
            continue
        tokens = [m.span() for m in _TOKEN.finditer(line)]
        at = 0
        while at < len(tokens):
            label, end = labels[at], at + 1
            while end < len(tokens) and labels[end] == label:
                end += 1
            if label:
                start, stop = _trimmed(texts[i], begin + tokens[at][0], begin + tokens[end - 1][1], LABELS[label])
                if start < stop and all(stop <= a or start >= b for _, a, b in base[i]):
                    out[i].append((f"m_{LABELS[label]}", start, stop))
            at = end
    return [sorted(spans, key=lambda s: (s[0], s[1])) for spans in out]


def find_pii(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``found``: an array of (kind, start, end), code points, end exclusive.

    Pattern spans come first, by kind as listed, then by start; then the field's, whose kinds
    begin with ``m_``, in the same order. Null and empty texts have none; texts of any length
    are labelled whole. Rows that repeat are treated alike, a null id stays null, other columns
    are not kept (so none can clash), and an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_column).try_cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    names, weights, moves = field.names, field.weights, field.moves
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(names, weights, moves)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                texts = batch.column("text").to_pylist()
                base = [pattern_spans(t) for t in texts]
                more = model_spans(texts, base, model)
                found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in a + b] for a, b in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "found"])

    return map_arrow(narrow, run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the pattern spans, and all spans as text."""

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):  # noqa: ANN202
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )
