"""Words of many texts at once, as numpy arrays of 64-bit hashes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Texts are UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) <= n:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(max(n, PIECE) + 1, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def _hash_piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [len(b)]))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word. Works through pieces cut between words, so memory is bounded by words and the longest word."""
    whole = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(whole):
        stop = min(len(whole), at + PIECE)
        while stop < len(whole):
            inside = whole[at:stop]
            gap = np.flatnonzero(_SPACE[inside[-4096:]])
            if len(gap):
                stop = stop - min(4096, len(inside)) + int(gap[-1]) + 1
                break
            stop = min(len(whole), stop + 4096)
        piece = _LOWER[whole[at:stop]] if lower else whole[at:stop]
        s, e, h = _hash_piece(piece)
        parts.append((s + at, e + at, h))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Words:
    """Words of consecutive texts: text i has the words first[i] to first[i + 1]; doc has each word's text."""

    texts: list[bytes]
    first: np.ndarray
    hash: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.texts)


def word_batches(texts: list[bytes | None], lower: bool = False, most: int = PIECE) -> Iterator[Words]:
    """Groups of texts of about `most` bytes together (or one longer text). A null text has no words."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append(t or b"")
        size += len(group[-1]) + 1
        if size >= most:
            yield _words(group, lower)
            group, size = [], 0
    if group:
        yield _words(group, lower)


def _words(texts: list[bytes], lower: bool) -> Words:
    start, _, h = hash_words(b" ".join(texts), lower)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(start, offsets)
    return Words(texts, first, h, np.repeat(np.arange(len(texts)), np.diff(first)))


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each n consecutive entries."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    count = len(h) - n + 1
    out = np.full(count, (salt * 0xA0761D6478BD642F + n) & (2**64 - 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0xE7037ED1A0B428DB)
        out += h[k : k + count]
    return mix(out)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Which starts of n-word windows keep all their words in one text."""
    count = max(0, len(doc) - n + 1)
    return doc[:count] == doc[n - 1 : n - 1 + count]
