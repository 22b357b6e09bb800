"""Operator 10: near-duplicates by fast similarity sketches, banding and exact verification.

1. Each text becomes its set of word shingles, and the set a sketch of BANDS * ROWS coordinates
   (claimloom.llm.sketch) whose bands are hashed to keys. Texts with equal sets form a class;
   only the class's least id goes on.
2. Ids that share a band key are candidates. Pairs within a key are never listed. In each key
   the id that shares most keys with others is the hub, each id is paired with its best hub only,
   and the pair is verified on the full sets.
3. Candidates that hang together form a cluster. In a cluster, ids linked to the largest hub are
   one side, all others are left over; every left-over id is compared, on full sets, with every
   id of the cluster. These comparisons are dealt in blocks of bounded size, counted in ids
   and in bytes of their sets; one task holds some blocks, and a block returns one link per
   left-over id and hub, not all pairs.
4. Links from 2 and 3 give connected components.

So a link between different texts is lost only if its two sketches agree in no band. At a
similarity of 0.8 that has a chance of (1 - 0.8**ROWS)**BANDS, below 8 in a million, and less
above.

Defined results: text null or without words has an empty set, is linked with nothing and is its
own component. A row without an id takes no part: its component is null and it is kept. Rows
that repeat an id get a row each. An empty table gives an empty result. Memory of a task is
bounded by a batch of texts, the longest text, or one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import IdFilter, arrow_column, bound_batches, filter_bits, fresh, id_filter, materialize, text_bytes
from claimloom.llm.components import components
from claimloom.llm.sketch import band_keys, shingle_sets, sketch
from claimloom.llm.words import mix

BANDS, ROWS = 64, 8
#: Sizes of a block, on average: left-over ids and ids of their cluster, and bytes of their sets.
LEFT, ALL = 512, 2_048
LEFT_BYTES, ALL_BYTES = 4 << 20, 16 << 20
#: Ids and bytes of sets in the blocks of one task, on average.
UNIT, UNIT_BYTES = 2_048, 32 << 20


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_bytes(batch.column(1)):
                size, k1, k2, keys = [], [], [], []
                for s in shingle_sets(texts, n):
                    size.append(len(s))
                    with np.errstate(over="ignore"):
                        k1.append(int(mix(s).sum(dtype=np.uint64)))
                        k2.append(int((mix(s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)))
                    keys.append(band_keys(sketch(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
                lengths = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(size, pa.int64()), as_long(k1), as_long(k2), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))], ["doc_id", "n_shingles", "k1", "k2", "bands"])
                at += len(texts)

    return run


def _maybe_sets(wanted: IdFilter, n: int):
    """Packed shingle sets of the texts whose bit (the last column) is on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted.is_on(batch.column(2))))
            at = 0
            for texts in text_bytes(some.column(1)):
                yield pa.RecordBatch.from_arrays([some.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts, n)], pa.binary())], ["id", "set"])
                at += len(texts)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def linked(a: Column, b: Column, percent: int) -> Column:
    """Whether two packed sets have 100 * common >= percent * together."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            c = _common(s, t) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
            out.append(c > 0 and 100 * c >= percent * (len(s) + len(t) - c))
        return pa.array(out, pa.bool_())

    return arrow_column(run, "boolean")(a, b)


def _compare(percent: int):
    """One task's blocks: links of each left-over id to ids under other hubs, one per hub."""

    def one(left: list[tuple], every: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for _, _, x in every]
        sizes = np.array([len(s) for s in sets])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        terms, place = np.unique(np.concatenate(sets), return_inverse=True)
        ids, hubs = np.array([x[0] for x in every]), np.array([x[1] for x in every])
        held = np.zeros(len(terms), np.int32)
        for i, hub, packed in left:
            s = np.frombuffer(packed, np.uint64)
            at = np.searchsorted(terms, s)
            at = at[terms[np.minimum(at, len(terms) - 1)] == s]
            held[at] = 1
            c = np.add.reduceat(held[place], first)
            held[at] = 0
            good = np.flatnonzero((100 * c >= percent * (len(s) + sizes - c)) & (hubs != hub) & (ids != i))
            for k in {int(hubs[k]): k for k in good[::-1]}.values():
                yield i, int(ids[k])

    def run(unit: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        keys = unit.select(["cluster", "i", "j"]).to_pandas().reset_index()
        for _, places in keys.groupby(["cluster", "i", "j"])["index"]:  # one block's sets at a time
            rows = unit.take(pa.array(places.to_numpy()))
            left, every = (rows.filter(m) for m in (rows["is_left"], pc.invert(rows["is_left"])))
            if left.num_rows and every.num_rows:
                both = (list(zip(x["id"].to_pylist(), x["hub"].to_pylist(), x["set"].to_pylist(), strict=True)) for x in (left, every))
                found += one(*both)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _hubs(shared: DataFrame) -> DataFrame:
    """shared: (id, key), keys with more than one id. Returns (id, hub, score) for each id of a key and the key's hub, another id."""
    sized = shared.join(materialize(shared.groupBy("key").agg(F.count("*").alias("n")), "near-sizes"), "key")
    scored = materialize(sized.join(sized.groupBy("id").agg(F.sum("n").alias("score")), "id").select("id", "key", "score"), "near-scored")
    best = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("best"))
    best = materialize(best, "near-hubs")
    pairs = scored.select("id", "key").join(best, "key").select("id", (-F.col("best.minus")).alias("hub"), F.col("best.score").alias("score"))
    return pairs.where("id != hub").distinct()


def links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """classes: (id, bands, n_shingles), one row per class. Returns verified links (a, b), enough of them for the components."""
    keys = classes.select("id", F.explode("bands").alias("key"))
    several = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-keys")
    shared = keys.join(several, "key").select("id", "key")
    pairs = materialize(_hubs(materialize(shared, "near-shared")), "near-pairs")
    candidates = pairs.select("id").unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    sets = materialize(_candidate_sets(candidates, docs, id_col, text_col, n), "near-sets")

    best = pairs.groupBy("id").agg(F.max_by("hub", F.struct("score", -F.col("hub"))).alias("hub"))
    of_hub = sets.select(F.col("id").alias("hub"), F.col("set").alias("hub_set"))
    checked = best.join(sets, "id").join(of_hub, "hub").select("id", "hub", linked(F.col("set"), F.col("hub_set"), percent).alias("ok")).where("ok").select("id", "hub")
    stars = materialize(checked, "near-stars")

    cluster = components(pairs.select(F.col("id").alias("a"), F.col("hub").alias("b")), "near-clusters").withColumnRenamed("component", "cluster")
    placed = materialize(cluster.join(stars, "id", "left").select("id", "cluster", F.coalesce("hub", "id").alias("hub")), "near-placed")
    placed = materialize(placed.join(classes.select("id", (8 * F.col("n_shingles")).alias("bytes")), "id"), "near-sized")
    arms = placed.groupBy("cluster", "hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max_by(F.struct("hub", "n", "bytes"), F.struct("n", -F.col("hub"))).alias("m")
    clusters = arms.groupBy("cluster").agg(main, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("arms"))
    parts = lambda n, size, bytes_, most: F.greatest(F.ceil(n / size), F.ceil(bytes_ / most)).cast("int")
    n_i = parts(F.col("n") - F.col("m.n"), LEFT, F.col("bytes") - F.col("m.bytes"), LEFT_BYTES)
    clusters = materialize(clusters, "near-mixed").where("arms > 1").select("cluster", F.col("m.hub").alias("main"), n_i.alias("n_i"), parts(F.col("n"), ALL, F.col("bytes"), ALL_BYTES).alias("n_j"))
    members = placed.join(clusters, "cluster")
    members = members.select("id", "cluster", "hub", "bytes", (F.col("hub") != F.col("main")).alias("out"), "n_i", "n_j", F.pmod(F.xxhash64("id"), F.col("n_i")).cast("int").alias("at_i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_j")).cast("int").alias("at_j"))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = members.where("out").select("id", "cluster", "hub", "bytes", F.lit(True).alias("is_left"), F.col("at_i").alias("i"), spread("n_j").alias("j"))
    every = members.select("id", "cluster", "hub", "bytes", F.lit(False).alias("is_left"), spread("n_i").alias("i"), F.col("at_j").alias("j"))
    blocks = materialize(left.unionByName(every), "near-blocks")
    total = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    units = max(1, -(-total["n"] // UNIT), -(-total["bytes"] // UNIT_BYTES))
    unit = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(units)).alias("unit")
    found = blocks.join(sets, "id").select("id", "cluster", "hub", "is_left", "i", "j", "set", unit).groupBy("unit").applyInArrow(_compare(percent), "a bigint, b bigint")
    return stars.select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(found)


def _candidate_sets(candidates: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, set) of the candidates. Only sets of candidates, and of few others, leave the pass over all texts."""
    ids = docs[id_col].cast("bigint")
    wanted = filter_bits(candidates)
    rows = docs.select(ids.alias("id"), docs[text_col].alias("text"), wanted.bit(ids).alias("bit")).where("id IS NOT NULL")
    sets = rows.mapInArrow(_maybe_sets(wanted, n), "id bigint, set binary")
    return sets.join(candidates, "id", "left_semi").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    n: words of a shingle. percent: least similarity of a link. Ids are integers; where rows
    share an id but not a text, one of their texts stands for the id in verification.
    """
    bound_batches()
    schema = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"
    rows_ = materialize(docs.select(docs[id_col].cast("bigint"), docs[text_col]).mapInArrow(_signatures(n, bands, rows), schema), "near-rows")
    filled = rows_.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "near-classes")
    reps = filled.select(F.col("doc_id").alias("id"), "bands", "n_shingles").join(classes.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    found = components(links(reps, docs, id_col, text_col, n, percent))
    of_class = classes.join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = rows_.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that another document of their group stands for; columns unchanged. Of rows with equal ids one stays; all rows without an id stay."""
    result = materialize(near_duplicates(docs, id_col, text_col, n, percent).where("doc_id IS NOT NULL").select("doc_id", "kept"), "near-result")
    gone = result.where("NOT kept").select("doc_id").distinct()
    repeated = result.groupBy("doc_id").count().where("count > 1").select("doc_id")
    key, place, maybe = fresh(docs, "near_id"), fresh(docs, "near_place"), fresh(docs, "near_maybe")
    touched = id_filter(gone.unionByName(repeated))
    marked = docs.withColumn(maybe, touched(docs[id_col].cast("bigint")))
    near = marked.where(F.col(maybe)).withColumn(key, F.col(f"`{id_col}`").cast("bigint"))
    near = near.join(gone.withColumnRenamed("doc_id", key), key, "left_anti")
    near = near.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.col(f"`{text_col}`")))).where(F.col(place) == 1)
    return marked.where(~F.col(maybe)).select(*docs.columns).unionByName(near.select(*docs.columns))
