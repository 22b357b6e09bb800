"""Operator 11: a trie of conversations by their first turns, from sorted shards of padded turn-id matrices.

A conversation is a row: its turns' ids (16 bytes of hash of role and text each; texts are never
gathered) and the bytes of their texts. Rows are dealt to ranges of (ids, conv_id), so that the
members of a node, which share their first turns, are neighbours, and members of one sequence, however
many, can lie in many ranges. Sorted ranges reach Python in Arrow batches of bounded size, and each
batch is a shard: its turn ids become a padded matrix of small integers, a block of columns at a
time, that numpy sorts (lexsort); changes against the row above, OR-accumulated over columns, mark
where a node of each depth starts; reduceat over these starts aggregates members, children, leaves
and savings, from the deepest level up.

Nodes of a shard's first and last row can go on in another shard. The others are complete, and
final but for the id of a parent at the boundary. Boundary nodes (two paths a shard) recombine by
their key, a hash of the path: members and complete parts are summed by key; then each node's own
saving and leaf count, counted on the first path that has it, is summed along paths from the bottom.

The hash of a node's ends is over ids joined in order. Shards join their own; for boundary nodes the
pieces, in order, stream through one hash, which is serial by definition and needs no memory.

Defined results: rows without a conv_id belong to no conversation. Null roles and texts are empty.
Turns are in order of turn (null first), then role, then id; repeated rows are turns of their own. An
empty table has no nodes, not even a root. Extra columns are ignored. A conversation is one row here:
24 bytes a turn, so that a million turns are 24 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import bound_batches, materialize

#: Bytes of a turn's id, and columns of a matrix that are made at a time.
ID_BYTES = 16
BLOCK = 32
#: Boundary tables up to so many rows are sent to every task.
ROWS_SENT = 200_000
#: Depth of the root, and the hash of no ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()
COMPLETE, BOUNDARY, ENDS = 0, 1, 2

SCHEMA = "kind int, conv_id bigint, depth int, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, parent bigint, key binary, parent_key binary, shard string, path int, bytes bigint, ends binary"


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % heads.

    turns is an array of (id, bytes) in order.
    """
    c = conversations
    own = c.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"),
            turn_id(c["role"], c["text"]).alias("id"), F.octet_length(F.coalesce(c["text"], F.lit(""))).cast("bigint").alias("bytes"),
        ).alias("t"),
    )
    base = F.col("conv_id") - F.col("conv_id") % group
    # One shuffle: rows lie by base, for the lists and for the join of heads.
    lists = own.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("s"))
    lists = materialize(lists.select("base", "conv_id", F.transform("s", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("own")), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = lists.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head"))
    rest = F.when(F.size("own") > h, F.slice("own", h + 1, F.size("own"))).otherwise(F.slice("own", 1, 0))
    head = F.when(F.col("head").isNotNull() & (h > 0), F.slice("head", 1, h)).otherwise(F.slice("own", 1, 0))
    return lists.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


@dataclass
class Shard:
    """Sorted rows of a batch: conv_id, start in ids and sizes, length, and how many first turns each shares with the row above."""

    conv: np.ndarray
    first: np.ndarray
    length: np.ndarray
    ids: list[bytes]
    sizes: np.ndarray
    shared: np.ndarray


def padded(ids: np.ndarray, first: np.ndarray, length: np.ndarray, lo: int, width: int) -> np.ndarray:
    """Columns lo to lo + width of the matrix of turn ids, a row a conversation; -1 behind its end."""
    at = first[:, None] + lo + np.arange(width)
    inside = lo + np.arange(width) < length[:, None]
    m = np.full(at.shape, -1, np.int64)
    m[inside] = ids[at[inside]]
    return m


def sort_rows(conv: np.ndarray, first: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of rows by turn ids, then conv_id: lexsort of the blocks of columns, the last one first."""
    order = np.argsort(conv, kind="stable")
    deepest = int(length.max(initial=0))
    for lo in range(max(0, (deepest - 1) // BLOCK * BLOCK), -1, -BLOCK):
        longer = length[order] > lo
        rows = order[longer]
        if len(rows):
            m = padded(ids, first[rows], length[rows], lo, min(BLOCK, deepest - lo))
            order = np.concatenate((order[~longer], rows[np.lexsort(m.T[::-1])]))
    return order


def shared_turns(first: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many first turns each sorted row shares with the row above; -1 for the first row."""
    shared = np.zeros(len(first), np.int64)
    going = np.arange(1, len(first))  # rows that haven't changed yet
    lo = 0
    while len(going):
        m, above = (padded(ids, first[r], length[r], lo, BLOCK) for r in (going, going - 1))
        changed = np.logical_or.accumulate((m != above) | ((m < 0) & (above < 0)), axis=1)
        shared[going] += (~changed).sum(1)
        going = going[~changed[:, -1]]
        lo += BLOCK
    shared[:1] = -1
    return shared


def numbered(ids: list[bytes]) -> np.ndarray:
    """Small integers in the order of the ids' bytes, equal for equal ids."""
    halves = np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    rank = np.zeros(len(ids), np.int64)
    rank[order[1:]] = np.cumsum((halves[order[1:]] != halves[order[:-1]]).any(1))
    return rank


def shard_of(conv: np.ndarray, turns: pa.ListArray) -> Shard:
    """The sorted shard of a batch."""
    offsets = turns.offsets.to_numpy().astype(np.int64)
    first, length = offsets[:-1], np.diff(offsets)
    ids, sizes = turns.values.field(0).to_pylist(), turns.values.field(1).to_numpy(zero_copy_only=False)
    numbers = numbered(ids)
    order = sort_rows(conv, first, length, numbers)
    conv, first, length = conv[order], first[order], length[order]
    return Shard(conv, first, length, ids, sizes, shared_turns(first, length, numbers))


def path_keys(shard: Shard, row: int) -> list[bytes]:
    """Keys of the nodes of a row's path, the root first."""
    keys = [bytes(ID_BYTES)]
    for k in range(shard.first[row], shard.first[row] + shard.length[row]):
        keys.append(hashlib.blake2b(keys[-1] + shard.ids[k], digest_size=ID_BYTES).digest())
    return keys


def _joined(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def summarize(shard: Shard, name: str) -> Iterator[dict]:
    """Nodes of a shard, a dictionary of columns for each kind and depth (those of SCHEMA; others are null)."""
    n = len(shard.conv)
    if not n:
        return
    top, bottom = path_keys(shard, 0), path_keys(shard, n - 1)
    saved, leaves, kids = (np.zeros(n, np.int64) for _ in range(3))  # of complete nodes, at their first rows
    children: dict | None = None  # complete nodes of the level below, which wait for their parents
    deepest = int(shard.length.max())
    for lo in range(deepest // BLOCK * BLOCK, -1, -BLOCK):
        rows = np.flatnonzero(shard.length >= lo)
        length, shared, conv = shard.length[rows], shard.shared[rows], shard.conv[rows]
        sub_saved, sub_leaves, sub_kids = saved[rows], leaves[rows], kids[rows]
        for depth in range(min(deepest, lo + BLOCK - 1), lo - 1, -1):
            start = np.flatnonzero(shared < depth)
            stop = np.append(start[1:], len(rows))
            node = {
                "start": rows[start], "n_convs": stop - start, "conv_id": np.minimum.reduceat(conv, start),
                "saved": np.add.reduceat(sub_saved, start), "n_leaves": np.add.reduceat(sub_leaves, start), "n_children": np.add.reduceat(sub_kids, start),
                "n_ends": np.add.reduceat((length == depth).astype(np.int64), start),
            }
            on_top, at_bottom = rows[start] == 0, rows[stop - 1] == n - 1
            exists = length[start] >= depth
            node["bytes"] = np.zeros(len(start), np.int64)
            if depth:
                node["bytes"][exists] = shard.sizes[shard.first[rows[start[exists]]] + depth - 1]
            inner = exists & ~on_top & ~at_bottom
            if children:
                at = np.searchsorted(node["start"], children["start"], "right") - 1
                known = inner[at]
                keys = [None if k else top[depth] if t else bottom[depth] for k, t in zip(known.tolist(), on_top[at].tolist(), strict=True)]
                yield _complete(children, depth + 1, pa.array(node["conv_id"][at], mask=~known), keys)
            # A leaf has no children; complete nodes' children are complete.
            own, leaf = (node["n_convs"] - 1) * node["bytes"], (node["n_children"] == 0).astype(np.int64)
            sub_saved[start[inner]] += own[inner]
            sub_leaves[start[inner]] += leaf[inner]
            sub_kids[:] = 0
            sub_kids[start[inner]] = 1
            for k in np.flatnonzero(exists & ~inner).tolist():
                one = {c: int(v[k]) for c, v in node.items()}
                for path, keys in [*([(0, top)] if on_top[k] else []), *([(1, bottom)] if at_bottom[k] else [])]:
                    counted = path == 0 or not on_top[k]
                    row = {"conv_id": one["conv_id"], "bytes": one["bytes"]} | {c: one[c] if counted else 0 for c in ("n_convs", "n_children", "n_leaves", "saved")}
                    yield {"kind": [BOUNDARY], "depth": [depth], "shard": [name], "path": [path], "key": [keys[depth]], "parent_key": [keys[depth - 1] if depth else None]} | {c: [v] for c, v in row.items()}
                if one["n_ends"]:
                    ends = shard.conv[one["start"] : one["start"] + one["n_ends"]]
                    yield {"kind": [ENDS], "key": [(top if on_top[k] else bottom)[depth]], "conv_id": [int(ends[0])], "ends": [_joined(ends)]}
            children = {c: v[inner] for c, v in node.items()} if inner.any() else None
            if children:
                children["saved"], children["n_leaves"] = (node["saved"] + own)[inner], (node["n_leaves"] + leaf)[inner]
                spans = zip(children["start"].tolist(), children["n_ends"].tolist(), strict=True)
                children["ends"] = [hashlib.sha256(_joined(shard.conv[s : s + e])).hexdigest().encode() if e else NO_ENDS.encode() for s, e in spans]
        saved[rows], leaves[rows] = sub_saved, sub_leaves
        kids[:] = 0
        kids[rows] = sub_kids


def _complete(nodes: dict, depth: int, parent: pa.Array, parent_keys: list) -> dict:
    n = len(nodes["start"])
    return {"kind": [COMPLETE] * n, "depth": [depth] * n, "parent": parent, "parent_key": parent_keys} | {c: nodes[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")}


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_COLUMNS = [(name, _TYPES[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        shard = shard_of(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
        parts, rows = [], 0
        for found in summarize(shard, f"{part:08d}-{k:08d}"):
            n = len(found["kind"])
            parts.append(pa.RecordBatch.from_arrays([pa.array(found[c], t) if c in found else pa.nulls(n, t) for c, t in _COLUMNS], names=[c for c, _ in _COLUMNS]))
            rows += n
        if parts:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): the hash of each key's pieces, which come in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])


def nodes(rebuilt: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns): see the module for the columns' meaning."""
    bound_batches()
    ordered = rebuilt.select("conv_id", "turns").repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    found = materialize(ordered.mapInArrow(_shards, SCHEMA), "trie-shards")
    paths, pieces = found.where(F.col("kind") == BOUNDARY), found.where(F.col("kind") == ENDS)

    whole = paths.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.min(F.struct("shard", "path")).alias("owner"),
    )
    whole = materialize(whole, "trie-boundary")
    sent = F.broadcast if whole.count() <= ROWS_SENT else (lambda df: df)
    more = whole.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = whole.select("key", "owner", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"), (F.col("n_children") == 0).cast("bigint").alias("own_leaf"))

    up = Window.partitionBy("shard", "path").orderBy(F.col("depth").desc())
    is_owner = F.col("owner") == F.struct("shard", "path")
    below = paths.select("shard", "path", "depth", "key").join(sent(own), "key")
    below = below.select("key", *(F.sum(F.when(is_owner, F.col(c)).otherwise(0)).over(up).alias(c) for c in ("own_saved", "own_leaf")))
    below = below.groupBy("key").agg(F.sum("own_saved").alias("below_saved"), F.sum("own_leaf").alias("below_leaves"))
    ends = pieces.select("key", "ends", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(_hashed, "key binary, ends string")

    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_"))
    boundary = whole.join(below, "key").join(ends, "key", "left").join(parents, "parent_key", "left")
    boundary = boundary.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("parent_").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("below_leaves")).alias("n_leaves"), (F.col("saved") + F.col("below_saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    complete = found.where(F.col("kind") == COMPLETE).join(sent(parents), "parent_key", "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent", "parent_").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").cast("string").alias("ends_sha256"),
    )
    return complete.unionByName(boundary)
