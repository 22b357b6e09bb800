"""Operator 8: secrets by patterns and by the guess cost of values in credential contexts.

The patterns find assignments to credential names, access key ids and long hex strings. The
method looks at values in credential contexts (those names again, passphrase, pwd, bearer, private
key, client secret and others, with a value in quotes up to its closing quote on the line, or else
up to white space, a comma or a semicolon; passwords of `scheme://user:password@host`; values of
flags such as `-p` and `--token`, but for paths and other flags; bodies of private-key blocks) and asks what guessing each would
cost: a dynamic program splits the value into words, dates, repeats, keyboard walks, joins and
brute-force spans at the least total cost (log10 of guesses). A value that costs at least THRESHOLD
is a secret, or at least PHRASE if it is words and joins but for REST characters, as placeholders and
names are. Its whole span is added as kind `guess`, also where it goes on behind one of the patterns'
spans, but not where it lies in one.

Words are the common passwords below, and the words of a public vocabulary file in its order, which
goes from frequent to rare. The file's path is a parameter; without it only the former count.

Positions are code points, end exclusive. Texts are read whole. The dynamic program takes time in
proportion to the value's length, and ends as soon as no rest of the value can bring the cost below
what makes a secret, so a value of any length takes no more than its first part.

Defined results: a null text counts as empty and has no spans. Repeated rows, null ids and extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column

from claimloom.llm.common import arrow_column

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")
#: log10 of the guesses from which a value counts as secret.
THRESHOLD = 8.0
#: The same for values of words and joins, but for REST characters at most.
PHRASE = 15.0
REST = 2

_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# The base patterns' names stand anywhere in a name, as there; the others not after a letter or digit.
_NAMED = r"(?i:(?:password|passwd|secret|token|api[_-]?key|(?<![A-Za-z0-9])(?:passphrase|passcode|pass|pwd|auth|authorization|bearer|credentials?|private[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|signing[_-]?key|encryption[_-]?key|pin|login))[\"']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:(?:bearer|basic)[\x20\t]+)?)"
_FLAG = r"(?<!\S)(?:-p|--?(?:password|passwd|pass|passphrase|token|secret|api-?key|auth))(?:[\x20\t]+|=)(?![-/.~$])"
_VALUE = r"(?:\"([^\"\r\n]{6,})\"|'([^'\r\n]{6,})'|[\"']?([^\x00-\x20\"'<>,;]{6,}))"
_CONTEXT = re.compile(f"(?:{_NAMED}|{_FLAG}){_VALUE}", re.ASCII)
_ADDRESS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/@:]*:([^\s/@]{6,})@", re.ASCII)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s:,.-]+?)\s*-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.ASCII)
_CONTEXT_NAMES = ("pass", "pwd", "auth", "bearer", "credential", "key", "secret", "token", "pin", "login")

#: Common password words, most common first.
WORDS = (
    "password", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "princess", "sunshine", "shadow", "football", "baseball", "superman", "batman", "trustno", "hello", "freedom", "whatever", "secret",
    "love", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "june", "july", "august", "december", "test", "guest", "user", "root", "pass", "changeme", "default", "example",
    "sample", "demo", "the", "and", "you", "for", "this", "that", "with", "none", "null", "true", "false", "required", "string", "value", "token", "key", "your", "name",
    "computer", "internet", "server", "database", "service", "system", "network", "cookie", "flower", "ginger", "hunter", "killer", "soccer", "hockey", "tiger", "eagle", "angel", "charlie", "michael", "jordan",
)
#: Rows of a keyboard.
KEYS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("4@31!0$57", "aaeiiosst")
_BESIDE = {(row[i], row[i + d]) for row in KEYS for d in (-1, 1) for i in range(len(row)) if 0 <= i + d < len(row)} | {(a[i], b[j]) for a, b in zip(KEYS, KEYS[1:], strict=False) for i in range(len(a)) for j in (i - 1, i) if 0 <= j < len(b)}
_BESIDE |= {(b, a) for a, b in _BESIDE}
_DATES = (
    (re.compile(r"(?:19|20)[0-9]{2}[-/._]?[01][0-9][-/._]?[0-3][0-9]|[0-3]?[0-9][-/._][01]?[0-9][-/._](?:19|20)[0-9]{2}"), 4.6),
    (re.compile(r"(?:19|20)[0-9]{2}"), 2.1),
)
_JOINS = "-_. "
#: Costs of one more segment, of a word with other letters for some of its own, of one with capitals, of a join, and of a keyboard walk.
SEGMENT, LEET, CASED, JOIN, WALK = 0.5, 0.7, 0.3, 0.3, 1.5
MOST_PERIOD = 4
LONGEST_DATE = 10


@functools.lru_cache(maxsize=2)
def dictionary(path: str | None = None) -> dict[str, int]:
    """Rank of each word: the fixed ones first, then the ASCII words of three letters or more of a vocabulary file, by their number there."""
    ranks = {w: k + 1 for k, w in enumerate(WORDS)}
    if path is not None:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token, number in sorted(vocabulary.items(), key=lambda x: x[1]):
            word = token.lstrip("\u0120\u2581").lower()  # marks of a word's start
            if len(word) >= 3 and word.isascii() and word.isalpha():
                ranks.setdefault(word, len(WORDS) + number + 1)
    return ranks


@functools.lru_cache(maxsize=2)
def _longest(path: str | None) -> int:
    return max(map(len, dictionary(path)))


def alphabet(v: str) -> float:
    """log10 of the number of characters that v's are taken from."""
    size = 26 * any("a" <= c <= "z" for c in v) + 26 * any("A" <= c <= "Z" for c in v) + 10 * any("0" <= c <= "9" for c in v) + 33 * any(not c.isalnum() for c in v)
    return math.log10(max(size, 10))


def beside(a: str, b: str) -> bool:
    """Whether a walk goes on from a to b: neighbours on the keyboard or in the character table."""
    return (a, b) in _BESIDE or ord(b) - ord(a) in (1, -1)


def guess_cost(v: str, path: str | None = None, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """The least log10 of guesses over segmentations of v, and that segmentation as (kind, start, end).

    A walk, and a repeat of some period, begins where its run begins. Ends with a lower bound and no
    segmentation as soon as that bound is `enough`.
    """
    ranks, longest = dictionary(path), _longest(path)
    n, low = len(v), v.translate(_LOWER)
    plain = low.translate(_LEET)
    per_char, most = alphabet(v), max(longest, LONGEST_DATE)
    cost, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)

    def reach(end: int, c: float, kind: str, start: int) -> None:
        if c < cost[end]:
            cost[end], back[end] = c, (kind, start)

    brute, brute_from = math.inf, 0  # least cost where a brute-force span goes on, and its start
    walk = 0  # where the walk that reaches i began
    same = [0] * (MOST_PERIOD + 1)  # for each period, how many characters up to i equal the one a period before
    for i in range(n):
        if cost[i] + SEGMENT <= brute:
            brute, brute_from = cost[i] + SEGMENT, i
        brute += per_char
        reach(i + 1, brute, "brute", brute_from)
        if v[i] in _JOINS:
            reach(i + 1, cost[i] + JOIN, "join", i)
        for length in range(3, min(longest, n - i) + 1):
            for form, extra in ((low, 0.0), (plain, LEET)):
                rank = ranks.get(form[i : i + length])
                if rank:
                    cased = v[i : i + length] != low[i : i + length]
                    reach(i + length, cost[i] + SEGMENT + math.log10(rank + 1) + extra + CASED * cased, "word", i)
        for pattern, c in _DATES:
            if m := pattern.match(v, i):
                reach(m.end(), cost[i] + SEGMENT + c, "date", i)
        if i and not beside(low[i - 1], low[i]):
            walk = i
        if i + 1 - walk >= 3:
            reach(i + 1, cost[walk] + SEGMENT + WALK + 2 * math.log10(i + 1 - walk), "walk", walk)
        for period in range(1, MOST_PERIOD + 1):
            same[period] = same[period] + 1 if i >= period and v[i] == v[i - period] else 0
            length = same[period] + period
            if length >= 3 * period and same[period]:
                reach(i + 1, cost[i + 1 - length] + SEGMENT + period * per_char + math.log10(length / period), "repeat", i + 1 - length)
        if i % 16 == 15 and i + 1 < n:
            # A segmentation of v has a border among the last places, or a span that covers them: a brute one, or a run that goes on.
            least = min(min(cost[max(0, i + 1 - most) : i + 2]), brute, cost[walk], *(cost[i + 1 - same[p] - p] for p in range(1, MOST_PERIOD + 1) if same[p]))
            if least >= enough:
                return least, []
    parts, at = [], n
    while at:
        kind, start = back[at]
        parts.append((kind, start, at))
        at = start
    return cost[n], parts[::-1]


def is_secret(v: str, threshold: float = THRESHOLD, phrase: float = PHRASE, path: str | None = None) -> bool:
    """Whether guessing v costs too much for it to be a name or a placeholder."""
    cost, parts = guess_cost(v, path, max(threshold, phrase))
    other = sum(e - s for kind, s, e in parts if kind not in ("word", "join"))
    return cost >= (phrase if other <= REST else threshold)


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    low = t.lower()
    assign = [m.span() for m in _ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6] if any(x in low for x in _NAMES) else []
    access = [m.span() for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20] if "AKIA" in t else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in _HEX.finditer(t)]}


def context_values(t: str) -> list[tuple[int, int]]:
    """Values in credential contexts: leftmost, the longest of those that begin at one place, without overlap."""
    low, found = t.lower(), []
    if any(x in low for x in _CONTEXT_NAMES) and ("=" in t or ":" in t or "-" in t) or "-p" in t:
        found += [m.span(m.lastindex) for m in _CONTEXT.finditer(t)]
    if "://" in t:
        found += [m.span(1) for m in _ADDRESS.finditer(t)]
    if "PRIVATE KEY-----" in t:
        found += [m.span(1) for m in _BLOCK.finditer(t)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def not_within(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that don't lie in one of covers; both by start."""
    out, k, reach = [], 0, -1
    for start, end in spans:
        while k < len(covers) and covers[k][0] <= start:
            reach = max(reach, covers[k][1])
            k += 1
        if end > reach:
            out.append((start, end))
    return out


def all_spans(t: str | None, threshold: float = THRESHOLD, phrase: float = PHRASE, path: str | None = None) -> tuple[dict, list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans as (kind, start, end), by start and then by kind."""
    t = t or ""
    base = base_spans(t)
    more = not_within(context_values(t), sorted(x for v in base.values() for x in v))
    more = [(s, e) for s, e in more if is_secret(t[s:e], threshold, phrase, path)]
    spans = [(k, s, e) for k in BASE_KINDS for s, e in base[k]] + [("guess", s, e) for s, e in more]
    return base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = "spans array<struct<kind: string, start: int, end: int>>"


def detect(text: Column, threshold: float = THRESHOLD, phrase: float = PHRASE, path: str | None = None) -> Column:
    """Struct with `spans`, all of them, by start and kind. Those not of kind `guess` are the patterns'. path: a vocabulary file, on every worker."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        spans = []
        for at in range(0, len(texts), 256):
            for t in texts.slice(at, 256).to_pylist():
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, threshold, phrase, path)[1]])
        return pa.StructArray.from_arrays([pa.array(spans, kind)], ["spans"])

    return arrow_column(run, _SPANS)(text)
