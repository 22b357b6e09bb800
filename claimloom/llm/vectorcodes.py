"""Operator 13: vector codes by integer k-means over parts of vectors, with Drake-Hamerly adaptive bounds.

A component x is the integer floor(scale * x); a vector is cut into equal consecutive parts, and
each part position has a codebook. It starts as that part of the first kept vectors by id. A round
assigns each part to the nearest entry (squared Euclidean distance, ties to the lower index) and
moves each used entry to floor(sum / count); after the rounds, parts are assigned once more.

Each part keeps, in a table written once a round, its b closest entries by the last look (the
assigned one first), a lower bound of the distance to each of the others of these, in order, and one
outer bound for all entries that it doesn't keep. When entries move, a bound falls by its entry's
move, and the outer bound by the largest move of any. A part whose distance (exact, in integers) is
below all its bounds keeps its entry. Of the others, those below the outer bound compare their b
entries again, in integers; the rest compare all entries and choose their b closest anew. Bounds are
rounded down and need a margin to decide, so ties and close calls always come to the integers. b
starts at a quarter of the entries and falls, not below an eighth, to the number that would have
been least work in the round before (Drake and Hamerly take the most that any part needed).

Sums follow the parts that changed: a round adds up signed differences, pre-aggregated in each task.
The driver holds codebooks (parts x entries x components), nothing of the rows; a round's table
replaces the one before, so two exist at a time. Large components are exact, too: rows hold them in
2, 4, 8 or more bytes, and what doesn't fit 64-bit arithmetic is computed in Python's integers.

Defined results: rows are dropped whose vector is null, empty, or holds null or non-finite
components, or whose length isn't that of the kept vector that comes first. Rows come in order of
id, null ids last, then vector; repeated rows are rows of their own. Fewer rows than entries give
fewer entries. An empty table gives no rows. A first vector whose length the parts don't divide is
an error. An error above the largest long, or such a sum of a label, is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import bound_batches, drop_table, write_table

#: Codebooks with so many labels' sums, at most, are sent to every task.
LABELS_SENT = 100_000
#: Rows that are compared with all entries at a time.
ROWS_AT_ONCE = 4096
LONG_MAX = (1 << 63) - 1


@dataclass
class Codes:
    """rows: id, label, code (binary, a byte a part), error; codebooks: part, entry, component."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def codebooks_sha256(self) -> str:
        flat = (str(x) for part in self.codebooks for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def quantize(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where everything is below 2^62, else Python integers."""
    if not len(values) or np.abs(values).max() < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def binary_rows(a: np.ndarray) -> pa.Array:
    """Each row of an array as a binary value."""
    a = np.ascontiguousarray(a)
    width = a.nbytes // len(a) if len(a) else 0
    ends = np.arange(len(a) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(a.tobytes())])


def row_arrays(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    """The inverse: binary values of one width as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def pack(q: np.ndarray) -> pa.Array:
    """Rows of integers as little-endian bytes, each row of the least width that holds all its components."""
    widths = _widths(q)
    if len(set(widths.tolist())) == 1 and widths[0] <= 8:
        return binary_rows(q.astype(f"<i{widths[0]}"))
    rows = (r.astype(f"<i{w}").tobytes() if w <= 8 else b"".join(int(x).to_bytes(int(w), "little", signed=True) for x in r) for w, r in zip(widths.tolist(), q, strict=True))
    return pa.array(rows, pa.binary())


def _widths(q: np.ndarray) -> np.ndarray:
    if not len(q):
        return np.zeros(0, np.int64)
    most = np.maximum(q.max(1), -1 - q.min(1))
    if q.dtype == object:
        return np.array([2 if m < 1 << 15 else 4 if m < 1 << 31 else 8 if m < 1 << 63 else int(m).bit_length() // 8 + 1 for m in most])
    return np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))


def unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """Rows of components: int64, or Python integers if any row needs them."""
    rows = packed.to_pylist()
    widths = {len(r) // dims for r in rows}
    if len(widths) == 1 and (w := widths.pop()) <= 8:
        return np.frombuffer(b"".join(rows), f"<i{w}").reshape(-1, dims).astype(np.int64)
    q = np.zeros((len(rows), dims), object if any(w > 8 for w in widths) or any(len(r) > 8 * dims for r in rows) else np.int64)
    for k, r in enumerate(rows):
        w = len(r) // dims
        q[k] = [int.from_bytes(r[at : at + w], "little", signed=True) for at in range(0, len(r), w)]
    return q


@dataclass
class Entries:
    """Codebooks as arrays [part, entry, component], and by how much each entry moved in the last round (rounded up)."""

    at: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, books: list[list[list[int]]], before: list[list[list[int]]] | None) -> Entries:
        largest = max((abs(x) for p in books for e in p for x in e), default=0)
        at = np.array(books, np.int64 if largest < 1 << 62 else object)
        if before is None:
            return cls(at, np.zeros(at.shape[:2]))
        steps = [[sum((x - y) ** 2 for x, y in zip(e, f, strict=True)) for e, f in zip(p, q, strict=True)] for p, q in zip(books, before, strict=True)]
        return cls(at, np.array([[float(s) ** 0.5 * (1 + 1e-12) if s < 10**300 else np.inf for s in p] for p in steps]))


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to vectors, in the broadcast shape without the last axis."""
    if parts.dtype != object and entries.dtype != object:
        most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if (2 * most) ** 2 * parts.shape[-1] < 1 << 62:
            d = parts - entries
            return np.einsum("...k,...k->...", d, d)
    d = parts.astype(object) - entries.astype(object)
    return (d * d).sum(-1)


def _root(d: np.ndarray) -> np.ndarray:
    """Roots as doubles; what lies beyond doubles counts as 1e300, which no margin lets decide."""
    return np.sqrt(np.minimum(d, 10**300).astype(np.float64) if d.dtype == object else d.astype(np.float64))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


@dataclass
class Look:
    """What a part remembers: near [row, b] entries, the assigned one first; bound [row, b] for near[1:] and, last, for all others."""

    near: np.ndarray
    bound: np.ndarray

    @classmethod
    def none(cls, rows: int) -> Look:
        return cls(np.zeros((rows, 1), np.uint8), np.full((rows, 1), -np.inf, np.float32))


def narrowed(look: Look, b: int) -> Look:
    """The same with at most b entries kept: the outer bound covers the dropped ones."""
    if look.near.shape[1] <= b:
        return look
    outer = look.bound[:, b - 1 :].min(1)
    return Look(look.near[:, :b], np.column_stack((look.bound[:, : b - 1], outer)))


def assign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, look: Look, b: int) -> tuple[Look, np.ndarray, np.ndarray]:
    """One part position's rows against its codebook.

    Gives the new look, the exact squared distance to the assigned entry (the look's first), and how
    many kept entries each row needed: 0 if its bounds decided, up to b - 1, or b if it needed all.
    """
    n, k = len(parts), len(entries)
    b = max(1, min(b, k))
    near = look.near.astype(np.int64)
    kept = near.shape[1]
    # Bounds fall by the moves of their entries; the outer one by the largest of all.
    fall = np.column_stack((moved[near[:, 1:]], np.full(n, moved.max(initial=0.0))))
    bound = look.bound.astype(np.float64) - fall * (1 + 1e-12)
    d = squared(parts, entries[near[:, 0]])
    reach = _root(d) * (1 + 1e-12)
    open_at = ~(reach[:, None] < bound)  # an undecided comparison, ties included
    need = np.where(open_at[:, -1], kept, np.where(open_at.any(1), kept - 1 - np.argmax(open_at[:, -2::-1], 1) if kept > 1 else 0, 0))
    out = Look(np.zeros((n, b), np.uint8), np.zeros((n, b), np.float32))

    stay = need < kept
    if stay.any():
        rows = np.flatnonzero(stay & (need > 0))
        if len(rows):  # the kept entries again, in integers
            e = near[rows]
            again = squared(parts[rows, None, :], entries[e])
            order = _order(again, e)
            near[rows] = np.take_along_axis(e, order, 1)
            again = np.take_along_axis(again, order, 1)
            d[rows] = again[:, 0]
            bound[rows, :-1] = _root(again[:, 1:]) * (1 - 1e-12)
        rows = np.flatnonzero(stay)
        slim = narrowed(Look(near[rows].astype(np.uint8), _down(bound[rows])), b)
        out.near[rows], out.bound[rows] = slim.near, slim.bound

    unsure = np.flatnonzero(~stay)
    for at in range(0, len(unsure), ROWS_AT_ONCE):  # all entries
        rows = unsure[at : at + ROWS_AT_ONCE]
        every = squared(parts[rows, None, :], entries[None, :, :])
        order = _order(every, np.broadcast_to(np.arange(k), every.shape))
        every = np.take_along_axis(every, order, 1)
        d[rows] = every[:, 0]
        out.near[rows] = order[:, :b]
        rest = _root(every[:, 1 : b + 1]) * (1 - 1e-12)
        if rest.shape[1] < b:  # no entry is outside
            rest = np.column_stack((rest, np.full(len(rows), np.inf)))
        out.bound[rows] = _down(rest)
    return out, d, need


def _order(d: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Order of each row by distance, then entry."""
    if d.dtype == object:
        return np.array([sorted(range(d.shape[1]), key=lambda j, r=r: (d[r, j], entry[r, j])) for r in range(len(d))]).reshape(d.shape)
    return np.lexsort((entry, d), axis=1)


def finite_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold dims finite components, and these as doubles."""
    lengths = np.diff(vectors.offsets.to_numpy()) if vectors.null_count == 0 else None
    if lengths is not None and vectors.flatten().null_count == 0 and (lengths == dims).all():
        x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
        keep = np.isfinite(x).all(1)
        return keep, x[keep]
    keep, rows = np.zeros(len(vectors), bool), [np.zeros((0, dims))]
    for k, v in enumerate(vectors):
        if v.is_valid and len(v.values) == dims and v.values.null_count == 0:
            x = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            if np.isfinite(x).all():
                keep[k] = True
                rows.append(x[None, :])
    return keep, np.concatenate(rows)


def _kept(scale: int, dims: int):
    """Rows (id, label, q) of rows (id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = finite_rows(batch.column(2), dims)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pack(quantize(x, scale))], names=["id", "label", "q"])

    return run


def _round(entries: Entries, dims: int, b: int):
    """Rows (id, label, q, before, code, near, bound, need, error) of the round before, assigned again."""
    parts, k, size = entries.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = batch.num_rows
            if not n:
                continue
            q = unpack(col["q"], dims)
            first = col["near"].null_count == n
            if not first:
                near_at = row_arrays(col["near"], np.uint8, parts, -1)
                bound_at = row_arrays(col["bound"], np.float32, parts, -1)
            near, bound = np.zeros((n, parts, min(b, k)), np.uint8), np.zeros((n, parts, min(b, k)), np.float32)
            needs, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                look = Look.none(n) if first else Look(near_at[:, p], bound_at[:, p])
                look, d, need = assign(q[:, p * size : (p + 1) * size], entries.at[p], entries.moved[p], look, b)
                near[:, p], bound[:, p], needs[:, p] = look.near, look.bound, need
                error = error.astype(object) + d if d.dtype == object or int(d.max(initial=0)) >= 1 << 58 else error + d
            yield pa.RecordBatch.from_arrays(
                [
                    col["id"], col["label"], col["q"],
                    pa.nulls(n, pa.binary()) if first else col["code"],
                    binary_rows(near[:, :, 0]), binary_rows(near), binary_rows(bound), binary_rows(needs),
                    pa.array([int(x) if x <= LONG_MAX else None for x in error.tolist()], pa.int64()),
                ],
                names=["id", "label", "q", "before", "code", "near", "bound", "need", "error"],
            )

    return run


#: Sums are added up in digits of this many bits, so that none overflows in 2^37 rows.
DIGIT = 24
#: In a round's figures: the place of an entry's count, and that of the number of parts that needed so many entries.
COUNT, NEED = -1, -2


def digits(q: np.ndarray) -> list[np.ndarray]:
    """Integers in base 2^DIGIT, lowest first; the last digit carries the sign."""
    out = []
    while True:
        rest = q >> DIGIT
        if ((rest == 0) | (rest == -1)).all():
            return [*out, q.astype(np.int64)]
        out.append((q & ((1 << DIGIT) - 1)).astype(np.int64))
        q = rest


def _figures(parts: int, k: int, dims: int):
    """Figures (part, entry, place, digit, value) of a round: signed sums and counts of the parts that changed, and NEED."""
    size = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count = np.zeros((parts, k), np.int64)
        needs = np.zeros(257, np.int64)
        for batch in batches:
            q = unpack(batch.column(0), dims)
            after = row_arrays(batch.column(2), np.uint8, parts).astype(np.int64)
            had = batch.column(1).null_count == 0
            before = row_arrays(batch.column(1), np.uint8, parts).astype(np.int64) if had else None
            needs += np.bincount(row_arrays(batch.column(3), np.uint8, parts).ravel(), minlength=257)
            for p in range(parts):
                rows = np.flatnonzero(before[:, p] != after[:, p]) if had else np.arange(len(q))
                if not len(rows):
                    continue
                values = digits(q[rows, p * size : (p + 1) * size])
                for sign, codes in ((1, after), *(((-1, before),) if had else ())):
                    entry = codes[rows, p]
                    count[p] += sign * np.bincount(entry, minlength=k)
                    at = (entry[:, None] * size + np.arange(size)).ravel()
                    for digit, value in enumerate(values):
                        into = total.setdefault(digit, np.zeros((parts, k * size), np.int64))
                        # Exact in doubles: a batch has far fewer than 2^28 rows.
                        into[p] += sign * np.bincount(at, weights=value.ravel(), minlength=k * size).astype(np.int64)
        p, e = np.nonzero(count)
        none = np.zeros(len(p), np.int64)
        out = [(p, e, none + COUNT, none, count[p, e])]
        n = np.flatnonzero(needs)
        none = np.zeros(len(n), np.int64)
        out.append((none, n, none + NEED, none, needs[n]))
        for digit, sums in total.items():
            p, at = np.nonzero(sums)
            out.append((p, at // size, at % size, np.full(len(p), digit), sums[p, at]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["part", "entry", "place", "digit", "value"])

    return run


def best_width(needs: dict[int, int], b: int, k: int) -> int:
    """The number of kept entries, at most b and at least an eighth of all, that would have been least work for rows that needed so many."""

    def work(w: int) -> float:
        return sum(n * (0 if need == 0 else w if need < w else k) for need, n in needs.items()) + 0.25 * w * sum(needs.values())

    return min(range(max(1, k // 8), b + 1), key=lambda w: (work(w), w), default=b)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes and codebooks of a table of vectors. entries is at most 256, scale a power of two."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    bound_batches()
    source = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    kind = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    head = f"id {kind['id']}, label {kind['label']}, q binary"

    # The first rows: a bounded top-k.
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ordered = source.where((F.size("v") > 0) & finite).orderBy(F.col("id").asc_nulls_last(), "v")
    first = [r[0] for r in ordered.limit(entries).select("v").collect()]
    if not first:
        none = source.limit(0).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
        return Codes(none, [[] for _ in range(parts)])
    dims = len(first[0])
    if dims % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {dims} components")
    if any(len(v) != dims for v in first):
        first = [r[0] for r in ordered.where(F.size("v") == dims).limit(entries).select("v").collect()]
    start = [quantize(np.array(v, np.float64), scale).tolist() for v in first]
    size, k = dims // parts, len(start)
    books = [[e[p * size : (p + 1) * size] for e in start] for p in range(parts)]

    state = "before binary, code binary, near binary, bound binary, need binary, error bigint"
    rows = source.mapInArrow(_kept(scale, dims), head)
    rows = rows.select("*", *(F.lit(None).cast("binary").alias(c) for c in ("before", "code", "near", "bound", "need")), F.lit(None).cast("bigint").alias("error"))
    b = max(1, k // 4)
    before, place_of = None, None
    sums = [[[0] * size for _ in range(k)] for _ in range(parts)]
    counts = [[0] * k for _ in range(parts)]
    for r in range(rounds + 1):
        previous = place_of
        rows, place_of = write_table(rows.mapInArrow(_round(Entries.of(books, before), dims, b), f"{head}, {state}"), f"codes-{r}")
        if previous:
            drop_table(vectors.sparkSession, previous)
        if r == rounds:
            break
        figures = rows.select("q", "before", "code", "need").mapInArrow(_figures(parts, k, dims), "part bigint, entry bigint, place bigint, digit bigint, value bigint")
        needs: dict[int, int] = {}
        for p, e, place, digit, value in figures.groupBy("part", "entry", "place", "digit").agg(F.sum("value")).collect():
            if place == NEED:
                needs[e] = value
            elif place == COUNT:
                counts[p][e] += value
            else:
                sums[p][e][place] += value << (DIGIT * digit)
        before = books
        books = [[[s // counts[p][e] for s in sums[p][e]] if counts[p][e] else books[p][e] for e in range(k)] for p in range(parts)]
        b = best_width(needs, b, k)
    return Codes(rows.select("id", "label", "code", "error"), books)


def with_label_errors(codes: Codes, error_name: str = "label_error") -> DataFrame:
    """Rows of codes with the error summed over equal labels, nulls together."""
    rows = codes.rows
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("error").alias("m"))
    fits = (F.col("n") == F.col("m")) & (F.col("s") <= F.lit(LONG_MAX))
    total = total.select(F.col("label").alias("label_"), F.when(fits, F.col("s")).cast("bigint").alias(error_name))
    total, _ = write_table(total, "label-errors")
    few = total.count() <= LABELS_SENT
    return rows.join(F.broadcast(total) if few else total, F.col("label").eqNullSafe(F.col("label_")), "left").drop("label_")


def hex_code(code: Column) -> Column:
    """Two lower-case hex digits for each part."""
    return F.lower(F.hex(code))
