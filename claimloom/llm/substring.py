"""Operator 6: repeated passages by relative Lempel-Ziv parsing against indexed blocks.

Every document is parsed against all documents with smaller ids. A block is the passage around
an anchor: in each window of WINDOW words, the ANCHOR-word sequence with the least hash is the
window's anchor, and consecutive windows with one anchor form a block. Equal windows have equal
anchors, wherever they stand, so a document needs to be matched only with blocks of its own
anchors.

1. The index has, for each anchor, its reference block: the document with the least id that has
   it, the block's place there, and whether all blocks of the anchor are equal.
2. A document's block whose anchor is in a smaller document, in equal blocks only, is matched with
   the reference block as a whole. That is the inside of long factors.
3. At the boundaries of factors the blocks around one anchor differ. There each window is looked
   up by itself, among the windows of all blocks with that anchor, for its first document and
   place.
4. The greedy parse goes from left to right: a factor begins at the first matched window and is
   extended word by word, over blocks, as long as the next window is matched where the reference
   goes on. So a factor is (start, length, reference, place): its words are those of the reference
   document from that place. Where the next window is matched elsewhere, the next factor begins,
   and overlaps the last one by the words of the windows that lie across the boundary.
5. Factors have WINDOW words or more; their union are the spans that are removed.

Index and look-ups are joins on hashes; anchors that many documents share are aggregated before
they are shuffled and never collected. Texts are read in each pass, and only those of documents
with matches are shuffled. 64 bits of an anchor plus 32 bits of a block's fingerprint, or 96 bits
of a window's hash, decide whether words are equal.

Defined results: a text that is null or has fewer than WINDOW words keeps all its words. A row
without an id keeps all its words and is no reference. Rows that share an id are parsed each for
itself and are no references for each other; in factors that refer to them, the place is that in
one of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column, bound_batches, fresh, id_filter, materialize, text_bytes
from claimloom.llm.words import Words, inside, mix, windows, word_batches

WINDOW = 13
ANCHOR = 5


def _anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, their texts, and their anchors."""
    start = np.flatnonzero(inside(w.doc, window))
    grams = windows(w.hash, anchor)
    least = grams[start]
    for k in range(1, window - anchor + 1):
        least = np.minimum(least, grams[start + k])
    return start, w.doc[start], least


def _block_starts(doc: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which windows begin a block: the anchor, or the text, is another one than before."""
    return np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))


def _blocks(window: int, anchor: int):
    """One row for each block: id, anchor, a fingerprint of its windows, and its place, in words. Of equal blocks of a text the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for texts in text_bytes(batch.column(1)):
                for w in word_batches(texts):
                    start, doc, least = _anchors(w, window, anchor)
                    if len(start):
                        first = np.flatnonzero(_block_starts(doc, least))
                        print_ = np.add.reduceat(mix(windows(w.hash, window)[start]), first)
                        doc, least, place = doc[first], least[first], start[first] - w.first[doc[first]]
                        once = np.sort(np.unique(mix(least ^ (print_ << np.uint64(1))) ^ (doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_index=True)[1])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + doc[once]]), pa.array(least[once].view(np.int64)), pa.array((print_[once] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(place[once].astype(np.int32))], ["id", "anchor", "block", "place"])
                    at += len(w)

    return run


def _two(w: Words, window: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each window."""
    a, b = windows(w.hash, window)[start], windows(w.hash, window, salt=1)[start]
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _boundary_windows(window: int, anchor: int):
    """One row for each window under one of its document's mixed anchors: id, hash, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2).to_pylist()
            at = 0
            for texts in text_bytes(batch.column(1)):
                for w in word_batches(texts):
                    start, doc, least = _anchors(w, window, anchor)
                    edge = np.searchsorted(doc, np.arange(len(w) + 1))
                    hit = np.zeros(len(start), bool)
                    for i in range(len(w)):
                        if wanted[at + i]:
                            s = slice(edge[i], edge[i + 1])
                            hit[s] = np.isin(least[s].view(np.int64), wanted[at + i])
                    if hit.any():
                        h1, h2 = _two(w, window, start[hit])
                        place = (start[hit] - w.first[doc[hit]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + doc[hit]]), pa.array(h1), pa.array(h2), pa.array(place)], ["id", "h1", "h2", "place"])
                    at += len(w)

    return run


@dataclass
class Found:
    """References by key (an anchor, or a window's hash), sorted by key."""

    key: np.ndarray
    reference: np.ndarray
    place: np.ndarray

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and their rows."""
        if not len(self.key):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return self.key[at] == keys, at


def _lists(column: pa.Array) -> Iterator[Found]:
    """The rows of a column of lists of structs (key, reference, place)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    items = column.flatten()
    key, reference, place = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends, strict=True):
        order = a + np.argsort(key[a:b], kind="stable")
        yield Found(key[order], reference[order], place[order])


def match_windows(w: Words, window: int, anchor: int, blocks: Found, singles: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of one text whether it is matched, and the reference and place there."""
    n = max(0, len(w.hash) - window + 1)
    matched, reference, place = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        start, doc, least = _anchors(w, window, anchor)
        hit, row = blocks.look_up(least.view(np.int64))
        if hit.any():
            begins = np.flatnonzero(_block_starts(doc, least))
            within = start - start[begins[np.searchsorted(begins, np.arange(len(start)), "right") - 1]]
            matched[hit], reference[hit], place[hit] = True, blocks.reference[row[hit]], blocks.place[row[hit]] + within[hit]
        hit, row = singles.look_up(windows(w.hash, window)[start].view(np.int64))
        if hit.any():
            matched[hit], reference[hit], place[hit] = True, singles.reference[row[hit]], singles.place[row[hit]]
    return matched, reference, place


def greedy_factors(matched: np.ndarray, reference: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, reference, place) of the factors: each is extended from its first window as long as the next one goes on in its reference."""
    at = np.flatnonzero(matched)
    if not len(at):
        return []
    goes_on = (at[1:] == at[:-1] + 1) & (reference[at[1:]] == reference[at[:-1]]) & (place[at[1:]] == place[at[:-1]] + 1)
    begin = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    end = np.concatenate((begin[1:], [len(at)]))
    return [(int(at[a]), int(b - a) + window - 1, int(reference[at[a]]), int(place[at[a]])) for a, b in zip(begin, end, strict=True)]


def union(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, length) of the words that factors, in order of start, cover."""
    out: list[tuple[int, int]] = []
    for start, length, *_ in factors:
        if out and start <= out[-1][0] + out[-1][1]:
            a, n = out[-1]
            out[-1] = (a, max(n, start + length - a))
        else:
            out.append((start, length))
    return out


def _parse(window: int, anchor: int):
    def run(texts: pa.Array, whole: pa.Array, single: pa.Array) -> pa.Array:
        n_words, all_factors, all_spans, kept = [], [], [], []
        references = zip(_lists(whole), _lists(single), strict=True)
        for rows in text_bytes(texts):
            for t in rows:
                blocks, ones = next(references)
                words = (t or b"").split()
                factors: list[tuple[int, int, int, int]] = []
                if (len(blocks.key) or len(ones.key)) and len(words) >= window:
                    factors = greedy_factors(*match_windows(next(word_batches([t])), window, anchor, blocks, ones), window)
                spans = union(factors)
                n_words.append(len(words))
                all_factors.append([{"start": a, "length": n, "reference": r, "place": p} for a, n, r, p in factors])
                all_spans.append([{"start": a, "length": n} for a, n in spans])
                for a, n in reversed(spans):
                    del words[a : a + n]
                kept.append(b" ".join(words))
        factor = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("reference", pa.int64()), ("place", pa.int32())]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(all_factors, factor), pa.array(all_spans, span), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "factors", "spans", "kept"])

    return run


_PARSED = "n_words bigint, factors array<struct<start: int, length: int, reference: bigint, place: int>>, spans array<struct<start: int, length: int>>, kept string"


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with a column `parsed`: n_words, factors (start, length, reference document, place there, in words), spans (their union, which is removed) and kept (the text left, words joined by one space)."""
    bound_batches()
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    known = rows.where("id IS NOT NULL")
    blocks = known.mapInArrow(_blocks(window, anchor), "id bigint, anchor bigint, block int, place int")
    index = blocks.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("place", "id").alias("place"), F.min("block").alias("block_a"), F.max("block").alias("block_b"))
    index = index.where("first < last").select("anchor", "first", "place", (F.col("block_a") != F.col("block_b")).alias("mixed"))
    index = materialize(index, "passage-index")  # the joins below can split an anchor or window that many documents share only where both sides are shuffled for them
    hits = blocks.select("id", "anchor").join(index, "anchor").where("mixed OR id > first")
    reference = F.struct(F.col("anchor").alias("key"), F.col("first").alias("reference"), "place")
    lists = hits.groupBy("id").agg(F.collect_set(F.when(F.col("mixed"), F.col("anchor"))).alias("mixed"), F.collect_set(F.when(~F.col("mixed"), reference)).alias("whole"))
    lists = materialize(lists, "passage-blocks")

    at_edges = lists.where("size(mixed) > 0").select("id", "mixed")
    edge_filter = id_filter(at_edges.select("id"))
    edge_windows = known.where(edge_filter(F.col("id"))).join(at_edges, "id").select("id", "text", "mixed").mapInArrow(_boundary_windows(window, anchor), "id bigint, h1 bigint, h2 int, place int")
    edge_windows = materialize(edge_windows, "passage-windows")
    first = edge_windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("place", "id").alias("at")).where("first < last")
    first = materialize(first, "passage-shared")
    single = F.struct(F.col("h1").alias("key"), F.col("first").alias("reference"), F.col("at").alias("place"))
    singles = edge_windows.select("id", "h1", "h2").join(first, ["h1", "h2"]).where("id > first").groupBy("id").agg(F.collect_set(single).alias("single"))

    key = fresh(docs, "passage_id")
    found = lists.select("id", "whole").where("size(whole) > 0").join(singles, "id", "full")
    found = materialize(found, "passage-matches").withColumnRenamed("id", key)
    maybe = fresh(docs, "passage_maybe")
    match_filter = id_filter(found.select(key))
    marked = docs.withColumn(maybe, match_filter(docs[id_col].cast("bigint")))
    whole, one = fresh(docs, "passage_whole"), fresh(docs, "passage_single")
    found = found.withColumnRenamed("whole", whole).withColumnRenamed("single", one)
    near = marked.where(F.col(maybe)).join(found, marked[id_col].cast("bigint") == found[key], "left").drop(key)
    none = F.lit(None).cast("array<struct<key: bigint, reference: bigint, place: int>>")
    far = marked.where(~F.col(maybe)).withColumn(whole, none).withColumn(one, none)
    parsed = fresh(docs, "parsed")
    run = arrow_column(_parse(window, anchor), _PARSED)
    done = [x.withColumn(parsed, run(F.col(f"`{text_col}`"), F.col(whole), F.col(one))).drop(maybe, whole, one) for x in (near, far)]
    return done[0].unionByName(done[1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages taken out of the texts; texts without any stay as they are. Columns unchanged."""
    out = parse(docs, id_col, text_col, window)
    parsed = out.columns[-1]
    text = F.when(F.size(f"{parsed}.spans") > 0, F.col(f"{parsed}.kept")).otherwise(F.col(f"`{text_col}`"))
    return out.withColumn(text_col, text).drop(parsed)
