"""Shingle sets and fast similarity sketches of many texts, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from claimloom.llm.words import Words, inside, mix, windows, word_batches


def shingle_sets(texts: list[bytes | None], n: int = 2) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, letters A-Z lower-cased. A text of 1 to n - 1 words has its whole sequence as one shingle; one without words has none."""
    for w in word_batches(texts, lower=True):
        yield from _sets(w, n)


def _sets(w: Words, n: int) -> Iterator[np.ndarray]:
    full = windows(w.hash, n)
    for i in range(len(w)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            yield windows(w.hash[a:b], b - a, salt=1)[:1]
        else:
            yield np.zeros(0, np.uint64)


def sketch(items: np.ndarray, t: int, seed: int = 0) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: t coordinates, equal between two sets with a chance of about their similarity.

    In round i (from 0) every item falls into a bin, and a bin that earlier rounds left empty
    keeps its least value. Rounds go on until no bin is empty; from round t on, round i puts
    every item into bin i - t, so all bins are full after 2t rounds at most. Coordinates carry
    their round, so they agree only where both sets filled the bin in the same round.
    """
    out = np.zeros(t, np.uint64)
    if not len(items):
        return out
    empty = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    value = empty.copy()
    many = max(1, math.ceil(t * (math.log(t) + 1.0) / len(items)))
    i = 0
    while i < t:
        rounds = np.arange(i, min(t, i + many), dtype=np.uint64)
        h = mix(items[None, :] ^ mix((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        # The round comes first in the value, so an earlier round always wins.
        keyed = (rounds[:, None] << np.uint64(40)) | (h & np.uint64(0xFFFFFFFF)) << np.uint64(8)
        np.minimum.at(value, bins.ravel().astype(np.int64), keyed.ravel())
        i += many
        if (value != empty).all():
            return value
    for b in np.flatnonzero(value == empty):
        h = mix(items ^ mix(np.array([t + b + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
        value[b] = (np.uint64(t + b) << np.uint64(40)) | (h.min() >> np.uint64(32)) << np.uint64(8)
    return value


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of `rows` coordinates; keys of different bands differ."""
    x = coordinates[: bands * rows].reshape(bands, rows)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for k in range(rows):
        out = mix(out ^ x[:, k]) * np.uint64(0x2545F4914F6CDD1D)
    return mix(out)
