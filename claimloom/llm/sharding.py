"""Operator 4: shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts form a group that no shard boundary divides. Groups are dealt into bounded buckets
by hash. In each bucket the differencing runs over partial partitions, tuples of one sum per
shard: the two with the largest spread are combined in opposite order, the largest sum of one
with the smallest of the other, until one is left. Each bucket's last tuple is a partial
partition of the next level, differenced the same way, until one remains. So no task holds more
than one bucket, and the spread at each level is that of a few nearly even tuples.

Rows then get gapless slots in their shard: counts of hashed chunks give each chunk its first
slot, and rows are numbered within a chunk.

Defined results: a null text has 0 bytes and size 1, and forms one group with empty texts.
Repeated rows are rows of one group with slots of their own. An empty table gives an empty
result. A group larger than a shard's share makes its shard larger; nothing else is uneven.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialize

SHARDS = 16
#: Most partial partitions that are combined in one task, on average.
BUCKET = 16_384
#: Rows that are numbered together, on average.
CHUNK = 4_096


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (one row of `sums` each).

    Returns the final sums, in descending order, and for each input row the final place of each
    of its entries.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    tuples: list[list[int]] = np.take_along_axis(sums, order, 1).tolist()
    heap = [(t[-1] - t[0], i) for i, t in enumerate(tuples)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = [x + y for x, y in zip(tuples[a], reversed(tuples[b]), strict=True)]
        place = sorted(range(k), key=both.__getitem__, reverse=True)
        tuples.append([both[i] for i in place])
        tuples[a] = tuples[b] = ()
        merged.append((a, b, place))
        heapq.heappush(heap, (tuples[-1][-1] - tuples[-1][0], len(tuples) - 1))
    labels: list = [None] * len(tuples)
    labels[-1] = list(range(k))
    for node in range(len(tuples) - 1, n - 1, -1):
        a, b, place = merged[node - n]
        mine = labels[node]
        la, lb = [0] * k, [0] * k
        for at, i in enumerate(place):
            la[i] = mine[at]
            lb[k - 1 - i] = mine[at]
        labels[a], labels[b], labels[node] = la, lb, None
    final = np.empty((n, k), np.int64)
    np.put_along_axis(final, order, np.array(labels[:n], np.int64), 1)
    return np.array(tuples[-1], np.int64), final


def _leaves(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Groups of a bucket: group sizes in, place of each group out."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["total", "gid"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(part), shards), np.int64)
        sums[:, 0] = part["total"]
        _, final = difference(sums)
        return pd.DataFrame({"gid": part["gid"], "total": part["total"], "node": part["node"], "place": final[:, 0]})

    return run


def _level(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Tuples of a bucket (node, place, total): parent place of each (node, place)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="node", columns="place", values="total", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
        sums, final = difference(wide.to_numpy(np.int64))
        nodes = np.repeat(wide.index.to_numpy(), shards)
        return pd.DataFrame({"parent": part["parent"].iloc[0], "node": nodes, "place": np.tile(np.arange(shards), len(wide)), "up": final.ravel(), "total": wide.to_numpy().ravel()})

    return run


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """groups: (gid, total), one row per group. Returns (gid, shard)."""
    nodes = max(1, -(-groups.count() // bucket))
    leaf = groups.select("gid", "total", F.pmod(F.xxhash64("gid"), F.lit(nodes)).alias("node"))
    placed = materialize(leaf.groupBy("node").applyInPandas(_leaves(shards), "gid binary, total bigint, node bigint, place bigint"), "shard-groups")
    tuples = placed.groupBy("node", "place").agg(F.sum("total").alias("total"))
    out = placed.select("gid", "node", "place")
    while True:
        parents = max(1, -(-nodes // bucket))
        up = tuples.withColumn("parent", F.pmod(F.col("node"), F.lit(parents))).groupBy("parent").applyInPandas(_level(shards), "parent bigint, node bigint, place bigint, up bigint, total bigint")
        up = materialize(up, "shard-level")
        out = out.join(up.select("node", "place", "parent", "up"), ["node", "place"]).select("gid", F.col("parent").alias("node"), F.col("up").alias("place"))
        if parents == 1:
            return out.select("gid", F.col("place").cast("int").alias("shard"))
        tuples = up.groupBy(F.col("parent").alias("node"), F.col("up").alias("place")).agg(F.sum("total").alias("total"))
        nodes = parents


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per row of docs."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = materialize(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("gid")), "shard-rows")
    placed = assign(materialize(rows.groupBy("gid").agg(F.sum("size").alias("total")), "shard-sizes"), shards, bucket)
    chunks = max(1, -(-rows.count() // (shards * chunk)))
    rows = rows.join(placed, "gid").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(7)), F.lit(chunks)).alias("chunk"))
    rows = materialize(rows, "shard-placed")
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("first_slot"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("number", number).join(firsts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("number") - 1).alias("slot"))
