"""Spans of texts, as pairs of start and end (exclusive)."""

from __future__ import annotations


def free_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, sorted, that overlap none of taken, which is sorted. One pass over both: taken spans may overlap each other."""
    out, k, reach = [], 0, 0  # reach: the largest end of the taken spans that start before a span's end
    for s, e in sorted(spans, key=lambda x: x[1]):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:
            out.append((s, e))
    return sorted(out)
