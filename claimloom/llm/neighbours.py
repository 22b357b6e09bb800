"""Operator 9: approximate nearest neighbours in hash-prefix forests.

Vectors are dealt evenly into partitions. Each partition is a forest of TREES trees: for every
tree each vector has a string of BITS hash bits, kept as a sorted array of integers. Bit j of a
tree says on which side of a random hyperplane, placed at the median of a bounded sample, the
vector lies. Forests are built once and written.

A query descends in each tree to the vectors with the longest prefix in common with it, and then
ascends in all trees at once, one bit at a time. At each level every vector under the query's
prefix counts once more, so after the ascent a vector's count is the sum, over the trees, of how
far its prefix agrees. The ascent ends when the vectors seen number at least a share `reach` of
the partition. Those with the highest counts, `examined` of them, are compared by exact distance,
and the partitions' nearest are merged per query.

The number of trees that are used, reach and examined are measured, not given: of SETTLED forests (vectors are dealt by hash, so all
forests are alike), HELD vectors each, taken at random, are asked as queries, without themselves,
and their true nearest found by comparing with all. For a quarter, half and all of the trees and
each of REACHES, examined is what ranks TARGET of the true nearest among those compared; the
cheapest choice is kept in which at most half of the partition is compared, and of the forests'
choices the one that compares more. Where there is
none, as with vectors without any structure in hundreds of dimensions, nearness can't be told from
prefixes, and all vectors of the partitions are examined: an exact scan. Partitions below LEAST are
scanned, too. The target is met for queries that are distributed as the vectors are, up to the
error of SETTLED * HELD * k samples; tests hold recall above 0.9 for vectors without structure, of 64 and 128
components, in tables of 8,192 and of 65,536.

Partitions hold at most PART_BYTES, queries are broadcast in groups of at most QUERY_BYTES. For a group all partitions are searched at
the same time, each by a task that takes the group in blocks. Work is in proportion
to queries times partitions: where queries grow with the vectors, as a hundredth of them, it grows
faster than the table, with a factor that falls as partitions grow (partition_size).

Defined results: a vector takes no part, as query or candidate, if its id is null or it is null,
empty, zero, of another length than most, or has a null or non-finite component. Of rows that
share an id the least vector counts. Equal vectors are neighbours at distance 0, ties go to the
smaller id. With fewer candidates than k, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import bound_batches, materialize, scratch_path

TREES, BITS = 128, 24
TARGET, HELD, SETTLED = 0.96, 96, 2
REACHES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
LEAST = 512
#: How many places of a tree cost as much to look at as a candidate to compare.
COMPARED = 16
QUERY_BLOCK = 64
#: Bytes of a partition's vectors and strings; of the queries that are broadcast at once, and most such queries.
PART_BYTES, QUERY_BYTES = 96 << 20, 32 << 20
QUERY_GROUP = 32_768
SAMPLE = 4_096


def partition_size(n: int, dims: int, trees: int = TREES) -> int:
    """Vectors of a partition for a table of n: 8,192, and a 64th of the table up to 65,536, or what PART_BYTES holds, if that is less."""
    return max(1, min(1 << 16, max(1 << 13, n // 64), PART_BYTES // (8 * dims + 6 * trees)))


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Planes:
    """Hyperplanes of all trees, and the place of each."""

    def __init__(self, sample: np.ndarray, trees: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        self.trees, self.bits = trees, bits
        self.normals = r.standard_normal((sample.shape[1], trees * bits)).astype(np.float32)
        self.offsets = np.median(sample.astype(np.float32) @ self.normals, axis=0)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings, one row per tree."""
        weight = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        parts = [((x[at : at + 1024].astype(np.float32) @ self.normals > self.offsets).reshape(-1, self.trees, self.bits) @ weight).T for at in range(0, len(x), 1024)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((self.trees, 0), np.int64)


class Forest:
    """The trees of one partition of at most 65,536 vectors."""

    def __init__(self, bits: int, ids: np.ndarray, vectors: np.ndarray, strings: np.ndarray, order: np.ndarray):
        self.bits, self.ids, self.vectors = bits, ids, vectors
        self.trees = len(strings)
        # All trees' sorted strings in one array: a tree's number goes before its strings.
        self.sorted = ((np.arange(self.trees, dtype=np.int64)[:, None] << bits) | strings).ravel()
        self.order = order.ravel()

    @staticmethod
    def build(planes: Planes, ids: np.ndarray, vectors: np.ndarray) -> Forest:
        strings = planes.strings(vectors)
        order = np.argsort(strings, axis=1, kind="stable")
        return Forest(planes.bits, ids, vectors, np.take_along_axis(strings, order, 1), order.astype(np.uint16))

    def counts(self, strings: np.ndarray, reach: float) -> tuple[np.ndarray, int]:
        """For each query (a column of strings, a row for each of the first trees) and vector, how many bits of prefix they share, summed over these trees, as far as the ascent went; and the number of places looked at."""
        n, (trees, m) = len(self.ids), strings.shape
        keys = (np.arange(trees, dtype=np.int64)[:, None] << self.bits) | strings
        places = self.sorted[: trees * n]
        total = np.zeros(m * n, np.int64)
        live, looked = np.arange(m), 0
        for depth in range(self.bits, -1, -1):
            free = self.bits - depth
            low = (keys[:, live] >> free) << free
            a = np.searchsorted(places, low.ravel())
            size = np.searchsorted(places, (low + (1 << free)).ravel()) - a
            some = np.flatnonzero(size)
            if not len(some):
                continue
            a, size = a[some], size[some]
            query = np.repeat(live[some % len(live)], size)
            at = np.arange(len(query)) + np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            total += np.bincount(query * n + self.order[at], minlength=m * n)
            looked += len(at)
            live = live[(total.reshape(m, n)[live] > 0).sum(1) < reach * n]
            if not len(live):
                break
        return total.reshape(m, n), looked

    def settle(self, strings: np.ndarray, seed: int, k: int, target: float = TARGET) -> tuple[int, float, int]:
        """(trees, reach, examined) that find a share `target` of the k nearest of held-out vectors; examined is all where no more than half doesn't do.

        strings: those of all vectors, in their order.
        """
        n = len(self.ids)
        best = (np.inf, self.trees, 1.0, n)
        if n < LEAST:
            return best[1:]
        held = np.sort(np.random.default_rng(seed).choice(n, min(HELD, n), replace=False))
        near = np.stack([self._true(q, k) for q in held])
        enough = int(np.ceil(target * near.size)) - 1
        for trees in sorted({max(1, self.trees // 4), max(1, self.trees // 2), self.trees}):
            for reach in REACHES:
                ranks, looked = [], 0
                for at in range(0, len(held), 16):
                    c, places = self.counts(strings[:trees, held[at : at + 16]], reach)
                    looked += places
                    for row, true in zip(c, near[at : at + 16], strict=True):
                        # The worst place that a tie of counts can give; what wasn't seen has none.
                        ranks.append(np.where(row[true] > 0, n - np.searchsorted(np.sort(row), row[true], "left"), n + 1))
                need = int(np.sort(np.concatenate(ranks))[enough])
                cost = looked / len(held) + COMPARED * need
                if need <= n // 2 and cost < best[0]:
                    best = (cost, trees, reach, need)
                if looked / len(held) > best[0]:
                    break  # more reach looks at more
        return best[1:]

    def _true(self, q: int, k: int) -> np.ndarray:
        d = ((self.vectors - self.vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        return np.argpartition(d, min(k, len(d) - 1) - 1)[: min(k, len(d) - 1)]

    def nearest(self, query_id: int, query: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the vectors at the places `some`, by exact distance, then id."""
        at = some[self.ids[some] != query_id]
        d = np.sqrt(((self.vectors[at] - query) ** 2).sum(1))
        if len(d) > k:
            close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            at, d = at[close], d[close]
        best = np.lexsort((self.ids[at], d))[:k]
        return self.ids[at[best]], d[best]

    def candidates(self, strings: np.ndarray | None, queries: np.ndarray, reach: float, examined: int, k: int) -> list[np.ndarray]:
        """Places of the vectors to compare with each query: those with the highest counts; of an exact scan, all that can be among the k nearest."""
        n = len(self.ids)
        if examined < n:
            return [np.argpartition(-c, examined - 1)[:examined] for c in self.counts(strings, reach)[0]]
        # Squares by products of matrices, with room for their rounding; nearest() has the exact ones.
        own, theirs = (queries**2).sum(1), (self.vectors**2).sum(1)
        d = own[:, None] + theirs[None, :] - 2 * (queries @ self.vectors.T)
        most = min(k + 1, n)
        bound = np.partition(d, most - 1, axis=1)[:, most - 1]
        room = 1e-12 * self.vectors.shape[1] * (own + theirs.max(initial=0))
        return [np.flatnonzero(~(row > b + 2 * r)) for row, b, r in zip(d, bound, room, strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_FOREST = "part int, ids binary, vectors binary, strings binary, places binary"


def _builder(planes):
    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table["id"].to_numpy(), _matrix(table["v"])
        by_id = np.argsort(ids, kind="stable")
        f = Forest.build(planes.value, ids[by_id], vectors[by_id])
        strings = (f.sorted & ((1 << f.bits) - 1)).astype(np.uint32)
        row = {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("ids", f.ids.astype(np.int64)), ("vectors", f.vectors), ("strings", strings), ("places", f.order))}
        return pa.table({"part": table["part"].slice(0, 1)} | row)

    return run


def _read(batch: pa.RecordBatch, row: int, trees: int, bits: int) -> Forest:
    ids, vectors, strings, places = (np.frombuffer(batch.column(c + 1)[row].as_buffer(), t) for c, t in enumerate((np.int64, np.float64, np.uint32, np.uint16)))
    return Forest(bits, ids, vectors.reshape(len(ids), -1), strings.reshape(trees, -1).astype(np.int64), places.reshape(trees, -1))


def _settler(planes, seed: int, k: int, target: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                forest = _read(batch, row, planes.value.trees, planes.value.bits)
                trees, reach, examined = forest.settle(planes.value.strings(forest.vectors), seed, k, target)
                yield pa.RecordBatch.from_arrays([pa.array([trees], pa.int32()), pa.array([reach]), pa.array([examined / len(forest.ids)])], ["trees", "reach", "share"])

    return run


def _searcher(planes, group, k: int, used: int, reach: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = group.value
        p = planes.value
        for batch in batches:
            for row in range(batch.num_rows):
                forest = _read(batch, row, p.trees, p.bits)
                ids = forest.ids
                examined = len(ids) if share > 0.5 or len(ids) < LEAST else max(k + 1, int(np.ceil(share * len(ids))))
                step = max(1, QUERY_BLOCK * 8_192 // max(8_192, len(ids)))
                for at in range(0, len(query_ids), step):
                    i, q = query_ids[at : at + step], queries[at : at + step]
                    some = forest.candidates(p.strings(q)[:used] if examined < len(ids) else None, q, reach, examined, k)
                    out = [forest.nearest(int(a), b, c, k) for a, b, c in zip(i, q, some, strict=True)]
                    sizes = [len(x) for x, _ in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, sizes), pa.int64()), pa.array(np.concatenate([x for x, _ in out]), pa.int64()), pa.array(np.concatenate([d for _, d in out]), pa.float64())], ["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id bigint, vec_id bigint, score double"


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = TREES, bits: int = BITS, seed: int = 5, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of vectors where is_query, a condition on its id, holds. target: the recall that each forest is settled for."""
    bound_batches()
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == lengths["n"]).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    # By hash, so partitions differ in size; the bound on places in a forest leaves room for that.
    parts = max(1, -(-lengths["c"] * 5 // (4 * partition_size(lengths["c"], lengths["n"]))))
    index = materialize(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "forest-rows")
    sample = _matrix(index.select("v").orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).toArrow()["v"])
    planes = spark.sparkContext.broadcast(Planes(sample, trees, bits, seed))
    forests = materialize(index.select("part", "id", "v").repartition(parts, "part").groupBy("part").applyInArrow(_builder(planes), _FOREST), "forests")
    some = forests.where(F.col("part") < SETTLED)
    settled = some.mapInArrow(_settler(planes, seed, k, target), "trees int, reach double, share double").collect()
    used, reach, share = max((tuple(r) for r in settled), key=lambda x: x[2], default=(trees, 1.0, 1.0))
    in_group = min(QUERY_GROUP, max(1, QUERY_BYTES // (8 * lengths["n"])))
    groups = max(1, -(-2 * index.where("q").count() // in_group))  # by hash, so about half full
    queries = index.where("q").select("id", "v", F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).alias("group"))
    path = scratch_path(spark, "forest-found")
    for g in range(groups):
        group = queries.where(F.col("group") == g).select("id", "v").toArrow()
        if group.num_rows:
            shared = spark.sparkContext.broadcast((group["id"].to_numpy(), _matrix(group["v"])))
            forests.mapInArrow(_searcher(planes, shared, k, used, reach, share), _FOUND).write.mode("append").parquet(path)
            shared.destroy()
    spark.createDataFrame([], _FOUND).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = spark.read.schema(_FOUND).parquet(path)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
