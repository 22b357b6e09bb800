"""Operator 5: personal data by patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field adds spans
that the patterns miss (a phone number without +, or one that runs into another number; grouped
cards; national ids). It labels the words of a line from features of their shapes and of their
neighbours. It is trained here, by gradient ascent on the conditional likelihood, from a small
labelled table that a seeded generator writes; decoding is Viterbi over numpy batches.

A word without a digit and without @ is always labelled O. So the best path falls apart at such
words, and decoding runs of the other words, with O at either end, gives the best path of the
whole line. Texts without a digit or @ need no decoding.

Spans of the field that overlap a span of a pattern are dropped. Positions are code points, end
exclusive.

Defined results: a null text counts as empty and has no spans. Repeated rows, null ids and extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column
from claimloom.llm.spans import free_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ with the longest local part before it, from left to right."""
    out, done = [], 0
    p = t.find("@")
    while p >= 0:
        s = p
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            out.append((s, m.end()))
        done = m.end() if m else p + 1
        p = t.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    cards, phones = [], []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    for m in _PHONE.finditer(t):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            phones.append(m.span())
    return {"email": _emails(t), "ip": [m.span() for m in _IP.finditer(t) if all(map(_small, m.groups()))], "card": cards, "phone": phones}


# The field.

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TAG = {t: i for i, t in enumerate(TAGS)}
_CLUES = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "ssn": "ssn", "social": "ssn", "security": "ssn", "mail": "email", "email": "email", "ip": "ip", "host": "ip", "version": "version", "section": "version", "page": "version", "license": "version", "chapter": "version"}


def shape(word: str) -> str:
    """Letters as a or A in runs, digits as 9 one by one up to 6 and * beyond; other characters as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word)
    return re.sub(r"[0-9]+", lambda m: "9" * len(m[0]) if len(m[0]) <= 6 else "9*", s)


def features(words: list[str]) -> list[list[str]]:
    """Feature names of each word of a run; the words before and after the run may be given as its first and last."""
    shapes = ["^", *map(shape, words), "$"]
    out = []
    for i, w in enumerate(words):
        s, digits = shapes[i + 1], sum(c in "0123456789" for c in w)
        core = w.strip(".,;:!?\"'()[]<>*&%$#")
        prev = words[i - 1].lower().strip(".,:;#()") if i else ""
        f = ["bias", f"s={s}", f"core={shape(core)}", f"n={min(digits, 20)}", f"prev={shapes[i]}", f"next={shapes[i + 2]}", f"clue={_CLUES.get(prev, '')}"]
        f += [name for name, hit in (("@", "@" in w), ("dots3", w.count(".") >= 3), ("hyphen", "-" in core), ("paren", "(" in w), ("plus", w[:1] == "+"), ("mixed", any(c.isalpha() for c in w) and digits > 0), ("prevnum", shapes[i].strip("()+-.9*") == "" and "9" in shapes[i])) if hit]
        out.append(f)
    return out


def labelled_table(rows: int = 700, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The training table: short word sequences with their tags, half of them without personal data."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = ("the", "er", "on", "tion", "ing", "and", "re", "le", "que", "de", "ment", "der", "ung", "la", "os", "ar")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    name = lambda: word() + r.choice(("", f".{d(2)}", d(2), f"_{word()}"))

    def card() -> list[str]:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return [body] if r.random() < 0.4 else [body[i : i + 4] for i in range(0, 16, 4)] if r.random() < 0.6 else ["-".join(body[i : i + 4] for i in range(0, 16, 4))]

    def phone() -> list[str]:
        return r.choice(([f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(3), d(7)], [f"{d(3)}.{d(3)}.{d(4)}"], [f"+{d(11)}"]))

    private = {
        "email": lambda: [f"{name()}@{word()}{d(1)}.{word()}.com"],
        "ip": lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": card,
        "phone": phone,
        "ssn": lambda: [f"{d(3)}-{d(2)}-{d(4)}"],
    }
    clues = {"email": ("mail", "email"), "ip": ("ip", "host"), "card": ("card", "visa"), "phone": ("phone", "tel", "call"), "ssn": ("ssn", "social")}
    harmless = (
        lambda: [f"{r.randint(1, 40)}."], lambda: [str(r.randint(1900, 2100))], lambda: [f"{r.randint(1, 9)}.{r.randint(0, 20)}."], lambda: [f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"],
        lambda: [f"{r.randint(1, 28):02d}-{r.randint(1, 12):02d}-{r.randint(1990, 2030)}"], lambda: [f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"], lambda: [d(r.randint(1, 9))], lambda: [f"{d(1)},{d(3)},{d(3)}"],
        lambda: [f"{r.randint(0, 23)}:{d(2)}"], lambda: [f"{d(2)}%"], lambda: [f"${d(3)}.{d(2)}"], lambda: [f"({r.randint(1, 30)})"], lambda: [f"AKIA{word().upper()}{d(2)}Q{d(1)}"], lambda: [f"password={d(2)}a{d(3)}b{d(2)}c"], lambda: [f'"{d(2)}f{d(3)}ab{d(4)}c{d(3)}e"'],
        lambda: [f"{word()}{d(2)}"], lambda: [f"@{word()}"], lambda: ["@"], lambda: ["version", f"{d(1)}.{d(1)},"], lambda: [d(3), d(4)], lambda: [f"{d(1)}-{d(1)}"], lambda: [f"{d(2)}-{d(2)}"], lambda: [d(10)], lambda: [d(13)], lambda: [f"{d(3)}-{d(4)}"], lambda: [d(r.randint(20, 30))],
    )
    table = []
    for _ in range(rows):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 2)):
                words.append(word() + r.choice(("", "", "", ",", ".")))
                tags.append("O")
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.3:
                    words.append(r.choice(clues[kind]) + r.choice(("", ":")))
                    tags.append("O")
                found = private[kind]()
                tags += [f"{'I' if k else 'B'}-{kind}" for k in range(len(found))]
                if r.random() < 0.2:
                    found[-1] += r.choice(",.")
                words += found
            else:
                other = r.choice(harmless)()
                words += other
                tags += ["O"] * len(other)
        table.append((words, tags))
    return table


def _allowed() -> np.ndarray:
    """Transitions: I-x follows B-x or I-x only. Row 0 stands for the start, too."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for b, name in enumerate(TAGS):
        if name[0] == "I":
            ok[:, b] = [a[1:] == name[1:] and a != "O" for a in TAGS]
    return ok


_MINUS = -1e4


def _log_dot(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """log(exp(x) @ factors), row by row."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ factors + 1e-300)


class Field:
    """Weights of features by tag, and of transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(TAGS)))
        for i, f in enumerate(features(words)):
            out[i] = self.weights[[self.names[x] for x in f if x in self.names]].sum(0)
            if not _TRIGGER.search(words[i]):
                out[i, 1:] = _MINUS
        return out

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each run of scores; runs of one length are decoded together."""
        out: list = [None] * len(runs)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(runs):
            by_length.setdefault(len(x), []).append(i)
        for n, members in by_length.items():
            for at in range(0, len(members), 512):
                part = members[at : at + 512]
                x = np.stack([runs[i] for i in part])
                best = self.moves[0] + x[:, 0]
                back = np.zeros((len(part), n, len(TAGS)), np.int8)
                for t in range(1, n):
                    step = best[:, :, None] + self.moves
                    back[:, t] = step.argmax(1)
                    best = step.max(1) + x[:, t]
                tags = np.zeros((len(part), n), np.int64)
                tags[:, -1] = (best + self.moves[:, 0]).argmax(1)  # O follows
                for t in range(n - 1, 0, -1):
                    tags[:, t - 1] = back[np.arange(len(part)), t, tags[:, t]]
                for i, row in zip(part, tags, strict=True):
                    out[i] = row
        return out


@functools.lru_cache(maxsize=1)
def train(rows: int = 700, steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fits the field to labelled_table(rows) by Adam on the penalised conditional likelihood."""
    table = labelled_table(rows)
    names: dict[str, int] = {}
    for words, _ in table:
        for f in features(words):
            for x in f:
                names.setdefault(x, len(names))
    length = max(len(w) for w, _ in table)
    wide = max(len(f) for w, _ in table for f in features(w))
    ids = np.full((len(table), length, wide), len(names))
    gold = np.zeros((len(table), length), np.int64)
    plain = np.zeros((len(table), length), bool)
    live = np.zeros((len(table), length), bool)
    for i, (words, tags) in enumerate(table):
        live[i, : len(words)] = True
        for j, f in enumerate(features(words)):
            ids[i, j, : len(f)] = [names[x] for x in f]
            gold[i, j], plain[i, j] = _TAG[tags[j]], not _TRIGGER.search(words[j])
    plain |= ~live
    w, m = np.zeros((len(names) + 1, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    forbidden = ~_allowed()
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, m)]
    one = np.eye(len(TAGS))
    pairs = np.zeros_like(m)
    np.add.at(pairs, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    for step in range(1, steps + 1):
        moves = np.where(forbidden, _MINUS, m)
        factors = np.exp(moves)
        x = w[ids].sum(2)
        x[plain, 1:] = _MINUS
        alpha, beta = np.zeros_like(x), np.zeros_like(x)
        alpha[:, 0] = x[:, 0] + np.where(forbidden[0], _MINUS, 0)
        for t in range(1, length):
            alpha[:, t] = _log_dot(alpha[:, t - 1], factors) + x[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _log_dot(x[:, t + 1] + beta[:, t + 1], factors.T)
        z = _log_dot(alpha[:, -1], np.ones((len(TAGS), 1)))[:, 0]
        p = np.exp(alpha + beta - z[:, None, None])
        gw = np.zeros_like(w)
        np.add.at(gw, ids[live], ((one[gold] - p)[live])[:, None, :])
        gm = pairs.copy()
        for t in range(1, length):
            now = live[:, t]
            gm -= factors * (np.exp(alpha[now, t - 1] - z[now, None]).T @ np.exp(x[now, t] + beta[now, t]))
        gw[-1] = 0
        for value, g, (first, second) in ((w, gw / len(table), state[0]), (m, gm / len(table), state[1])):
            g = g - decay * value
            first *= 0.9
            first += 0.1 * g
            second *= 0.99
            second += 0.01 * g * g
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (0.3 if step > steps * 0.6 else 1)
    return Field(names, w, np.where(forbidden, _MINUS, m))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'[]<>*&%$#"


def _runs(t: str) -> list[list[re.Match]]:
    """Runs of words with a digit or @ on one line, with one word before and after for context."""
    runs: list[list[re.Match]] = []
    at = 0
    while m := _TRIGGER.search(t, at):
        stop = t.find("\n", m.start())
        stop = len(t) if stop < 0 else stop
        start = t.rfind("\n", at, m.start()) + 1 or at
        words = list(_WORD.finditer(t, start, stop))
        hot = [bool(_TRIGGER.search(w[0])) for w in words]
        i = 0
        while i < len(words):
            if hot[i]:
                j = i
                while j < len(words) and hot[j]:
                    j += 1
                runs.append(words[max(0, i - 1) : j + 1])
                i = j
            i += 1
        at = stop
    return runs


def field_spans(texts: list[str], field: Field) -> list[dict[str, list[tuple[int, int]]]]:
    """Spans that the field labels in each text, by kind."""
    out: list[dict[str, list[tuple[int, int]]]] = [{k: [] for k in KINDS} for _ in texts]
    owners, runs = [], []
    for i, t in enumerate(texts):
        if _TRIGGER.search(t):
            for words in _runs(t):
                owners.append((i, words))
                runs.append(field.scores([w[0] for w in words]))
    for (i, words), tags in zip(owners, field.viterbi(runs), strict=True):
        k = 0
        while k < len(words):
            name = TAGS[tags[k]]
            if name[0] == "B":
                j = k + 1
                while j < len(words) and TAGS[tags[j]] == f"I{name[1:]}":
                    j += 1
                s, e = words[k].start(), words[j - 1].end()
                while s < e and texts[i][s] in _EDGE:
                    s += 1
                while e > s and texts[i][e - 1] in _EDGE:
                    e -= 1
                if s < e:
                    out[i][name[2:]].append((s, e))
                k = j
            else:
                k += 1
    return out


def all_spans(texts: list[str | None], field: Field) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text its base spans by kind, and all spans as (kind, start, end), by kind and start."""
    texts = [t or "" for t in texts]
    found = []
    for t, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(t) if _TRIGGER.search(t) else {k: [] for k in BASE_KINDS}
        spans = {k: list(base.get(k, [])) for k in KINDS}
        if any(more.values()):
            taken = sorted(x for k in BASE_KINDS for x in base[k])
            for k, extra in more.items():
                spans[k] = sorted(spans[k] + free_of(extra, taken))
        found.append((base, [(k, s, e) for k in KINDS for s, e in spans[k]]))
    return found


_SPANS = "spans array<struct<kind: string, start: int, end: int>>, base array<struct<kind: string, start: int, end: int>>"


def detect(text: Column, docs: DataFrame, field: Field | None = None) -> Column:
    """Struct of `spans`, all of them, and `base`, those of the patterns, each by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        spans, base = [], []
        for at in range(0, len(texts), 256):
            for b, s in all_spans(texts.slice(at, 256).to_pylist(), shared.value):
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in s])
                base.append([{"kind": k, "start": x, "end": y} for k in BASE_KINDS for x, y in b[k]])
        return pa.StructArray.from_arrays([pa.array(spans, kind), pa.array(base, kind)], ["spans", "base"])

    return arrow_column(run, _SPANS)(text)


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with each span of personal data in the text replaced by <KIND>; other columns unchanged. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(texts), 256):
            rows = texts.slice(at, 256).to_pylist()
            for t, (_, spans) in zip(rows, all_spans(rows, shared.value), strict=True):
                if spans:
                    parts, done = [], 0
                    for k, s, e in sorted(spans, key=lambda x: x[1:]):
                        if e > done:
                            parts += [t[done : max(done, s)], f"<{k.upper()}>"]
                            done = e
                    t = "".join([*parts, t[done:]])
                out.append(t)
        return pa.array(out, pa.string())

    column = arrow_column(run, "string")(docs[text_col])
    return docs.select(*[column.alias(c) if c == text_col else docs[c] for c in docs.columns])
