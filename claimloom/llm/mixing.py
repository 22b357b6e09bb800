"""Operator 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the words to take, by weight; a share stops at `most` times the
source's size and its excess goes to the others by weight (water-filling). A source takes every
document once per complete epoch. The fraction of an epoch that is left is a weighted sample
without replacement: each document draws the exponential key -ln(u) / w, with u from a hash of
its id and w its quality weight, and documents are taken by ascending key until their words
reach the rest of the target.

The prefix sum over a source's keys is never made in one task. Keys fall into ordered buckets by
their logarithm, sums of buckets show which one holds the cut, and its rows fall into finer
buckets, and so on, until those around the cut are few enough to be ordered. Whatever the weights,
a round leaves a small part of a bucket. The cut, one row per source, then decides each document
where it lies.

Defined results: a null text has size 0; a null source is a source, the last one; a source of
size 0 has target 0. Documents of size 0 are taken 0 words. Rows with equal id, size and weight
are taken alike. An empty table gives an empty result. `targets` orders one row per source in one task. The document at the cut is taken whole if
that brings its source nearer to the target, so a source misses its target by half a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Rows around a cut that are ordered in one task.
ORDERED = 50_000
#: Sources are broadcast up to this count, and joined by shuffle beyond it.
BROADCAST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """1 for text without marks such as # or |, less with more of them, 0.05 at least."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(2.0) * marks / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of a digest of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds weight, target, epochs, rest."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", most * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    # Sources in order of ratio are full until the first whose share, of what is left, is not above its limit.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(level * F.col("weight"), most * F.col("source_size"))))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    return s.select("source", "source_size", "n_docs", "weight", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _per_source(rows: DataFrame, table: DataFrame, few: bool, kind: str = "inner") -> DataFrame:
    """rows with the columns of table, which has one row per source."""
    right = table.withColumnRenamed("source", "mix_source")
    return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(F.col("mix_source")), kind).drop("mix_source")


def _coarse() -> Column:
    """Bucket of a key: 64 for each doubling."""
    return F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * 64).cast("bigint")


def _crossing(rows: DataFrame, few: bool) -> DataFrame:
    """rows(source, bucket, size, key, rest, done): the bucket in which a source's words reach its rest: (source, cut, before, low, high, n), if any."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("done").alias("done"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    up_to = F.col("done") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    at = sums.withColumn("before", up_to - F.col("words")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    return at.select("source", F.col("bucket").alias("cut"), "before", "low", "high", "n")


def _cuts(rows: DataFrame, weights: tuple, share: float, most: float) -> tuple[DataFrame, bool]:
    """rows: (doc_id, source, size, key). One row per source: the columns of targets, `crosses`, whether its fraction of an epoch ends within it, and `last`, the last (key, doc_id, size) that is in; and whether it can be broadcast."""
    sources = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    left = _per_source(rows, sources.select("source", "rest"), few).where("size > 0 AND rest > 0").withColumns({"done": F.lit(0).cast("bigint"), "bucket": _coarse()})
    crossing = materialize(_crossing(left, few), "mix-crossing")
    crosses = crossing.select("source", F.lit(True).alias("crosses"))
    while True:
        left = _per_source(left.select("doc_id", "source", "size", "key", "rest", "bucket"), crossing, few).where("bucket = cut").withColumn("done", F.col("before"))
        widest = crossing.where("low < high").agg(F.max("n")).first()[0]
        if (widest or 0) <= ORDERED:
            break
        finer = F.when(F.col("high") > F.col("low"), F.least(F.lit(1023), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * 1024))).otherwise(F.lit(0)).cast("bigint")
        left = materialize(left.withColumn("bucket", finer).drop("cut", "before", "low", "high", "n"), "mix-near")
        crossing = materialize(_crossing(left, few), "mix-crossing")
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = left.withColumn("ahead", F.col("done") + ahead).where(F.col("ahead") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("own"))
    # Where the first row around the cut is out already, all of the buckets before it are in.
    before = crossing.select("source", F.struct(F.col("low").alias("key")).alias("start"))
    cut_of = _per_source(_per_source(_per_source(sources, crosses, few, "left"), before, few, "left"), ends, few, "left")
    return materialize(cut_of, "mix-cuts"), few


def _copies(rows: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's cut, and `selected`. Where nothing crosses, the rest is 0 or all of the source."""
    decided = _per_source(rows, cuts, few)
    inside = F.when(F.col("own").isNotNull(), F.struct("key", "doc_id", "size") <= F.col("own")).otherwise(F.col("key") < F.col("start.key"))
    selected = F.when(F.col("crosses").isNull(), F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))
    return decided.withColumn("selected", selected & (F.col("rest") > 0))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: str) -> list[Column]:
    w = quality_weight(docs[text_col]) if weight is None else weight
    return [docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), exponential_key(docs[id_col], w, seed).alias("key")]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, selected, taken): one row per row of docs.

    weight: the documents' quality weight, above 0 (default: quality_weight of the text).
    """
    rows = materialize(docs.select(*_rows(docs, id_col, text_col, source_col, weight, seed)), "mix-rows")
    out = _copies(rows, *_cuts(rows, weights, share, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "selected", ((F.col("epochs") + F.col("selected").cast("bigint")) * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns unchanged. Documents without words are dropped.

    Each row is decided from its own columns and its source's cut, so texts are not shuffled.
    """
    own = _rows(docs, id_col, text_col, source_col, weight, seed)
    cuts, few = _cuts(materialize(docs.select(*own), "mix-rows"), weights, share, most)
    taken = _copies(docs.select(*own, F.struct(*[docs[c] for c in docs.columns]).alias("mix_row")), cuts, few)
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("selected").cast("bigint")).otherwise(F.lit(0)).cast("int")
    return taken.select("mix_row", F.explode(F.array_repeat(F.lit(1), times))).select("mix_row.*")
