"""Substring search by character grams: candidates from a quote's rarest grams, then confirmed. On the fly for a table of quotes, or from an index that is kept.

A text that holds a quote has all of its grams (runs of at most three characters). So both are joined
on grams, each quote on the one or two that fewest texts have, and only these pairs are tested. No
text is compared with a quote that it shares no such gram with, also for quotes of a word or less.

`GramIndex` keeps the grams of texts of any length from one to three in a bucketed ledger, with the
number of texts of each, which follow additions and removals by signed differences. A search reads
the counts of its grams, the postings of the rarest, and the buckets of the candidates.

Defined results: null quotes and texts match nothing, and an empty quote is in no text. Quotes
and texts are compared as they are, or both in lower case. Grams are taken by UTF-16 units: a
character that takes two can only add candidates. On the fly they are numbers, made of code points.
Of rows that share an id in an addition, none may be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.plans.scratch import materialize
from claimloom.sources.ledger import Ledger, Table

LONGEST = 3
#: Grams of a quote whose texts are joined.
RAREST = 2
#: Bits of a code point, plus one, in a gram's number, and rows of grams that are handed on at once.
_BITS, _ROWS = 21, 200_000

TABLES = {
    "texts": Table("id bigint, text string", ("id",), ("id",)),
    "grams": Table("gram string, id bigint", ("gram",), ("gram", "id")),
    "gram_counts": Table("gram string, n bigint", ("gram",), ("gram",)),
}


def runs(text: Column, k: int) -> Column:
    """Distinct runs of k characters of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    at = F.when(F.length(text) >= k, F.sequence(F.lit(0), F.length(text) - k))
    with_chars = F.transform(F.array(chars), lambda cs: F.transform(at, lambda i: F.concat(*[F.coalesce(F.get(cs, i + j), F.lit("")) for j in range(k)])))
    return F.array_distinct(F.coalesce(F.element_at(with_chars, 1), F.array().cast("array<string>")))


def _of_quotes(quotes: DataFrame) -> DataFrame:
    """(item_id, gram) of quotes(item_id, quote): runs of three characters, or the whole of a shorter quote."""
    parts = [quotes.where(F.length("quote") >= LONGEST).select("item_id", F.explode(runs(F.col("quote"), LONGEST)).alias("gram"))]
    parts.append(quotes.where((F.length("quote") < LONGEST) & (F.length("quote") > 0)).select("item_id", F.col("quote").alias("gram")))
    return reduce(DataFrame.unionByName, parts)


def _numbers(text: bytes, widths: list[int] | None) -> np.ndarray:
    """Distinct runs of so many characters (without widths: of three, or the whole of a shorter text) as numbers, which tell their length, too."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64) + 1
    found = []
    for k in [min(len(chars), LONGEST)] if widths is None else widths:
        if 0 < k <= len(chars):
            found.append(np.unique(sum(chars[j : len(chars) - k + 1 + j] << (_BITS * j) for j in range(k))))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _numbered(rows: DataFrame, key: str, text: str, widths: list[int] | None = None) -> DataFrame:
    """(key, gram bigint) of rows(key, text), a row for each distinct gram of a text."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, n = [], [], 0
            for i, value in enumerate(batch.column(1)):
                at.append(i)
                found.append(_numbers(value.as_py(), widths))
                n += len(found[-1])
                if n >= _ROWS or i == batch.num_rows - 1:
                    ids = batch.column(0).take(pa.array(np.repeat(at, [len(x) for x in found])))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found))], names=[key, "gram"])
                    at, found, n = [], [], 0

    return rows.select(key, F.col(text).cast("binary").alias("bytes")).where("bytes IS NOT NULL").mapInArrow(numbers, T.StructType([rows.schema[key], T.StructField("gram", T.LongType())]))


def _rarest(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, gram, chosen): of wanted(item_id, gram) each item's rarest grams by counts(gram, n), and their number; no row for an item with a gram that no text has."""
    known = wanted.join(counts, "gram", "left")
    lost = known.where("n IS NULL").select("item_id").distinct()
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "gram"))
    best = known.join(lost, "item_id", "left_anti").withColumn("nth", nth).where(F.col("nth") <= RAREST)
    return best.select("item_id", "gram", F.count("*").over(Window.partitionBy("item_id")).alias("chosen"))


def _candidates(rarest: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(item_id, key) of the texts that have all chosen grams of an item."""
    hits = rarest.join(postings, "gram").groupBy("item_id", key).agg(F.count("*").alias("n"), F.first("chosen").alias("chosen"))
    return hits.where("n = chosen").select("item_id", key)


def candidates(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): pairs of quotes(item_id, quote) and texts(doc_id, text) that may match, all that do among them. Ids are unique."""
    wanted = materialize(_numbered(quotes, "item_id", "quote"), "quote-grams")
    needed = wanted.select("gram").distinct()
    width = F.when(F.col("gram") < 1 << _BITS, 1).when(F.col("gram") < 1 << (2 * _BITS), 2).otherwise(LONGEST)
    widths = sorted(r[0] for r in needed.select(width).distinct().collect())
    if not widths:
        return texts.join(quotes, F.lit(False)).select("item_id", "doc_id")
    seen = materialize(_numbered(texts, "doc_id", "text", widths).join(needed, "gram", "left_semi"), "text-grams")
    counts = materialize(seen.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    return _candidates(materialize(_rarest(wanted, counts), "rarest-grams"), seen, "doc_id")


class GramIndex:
    """An index of texts(id, text) for searches in any case."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 100_000):
        self.ledger = Ledger(spark, path, TABLES, bucket_rows)

    def _grams(self, texts: DataFrame) -> DataFrame:
        every = F.flatten(F.array(*[runs(F.lower("text"), k) for k in range(1, LONGEST + 1)]))
        return texts.where("text IS NOT NULL").select(F.explode(every).alias("gram"), "id")

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Add texts(id, text), in place of those with their ids, and remove ids(id), in one commit; returns the version."""
        version = self.ledger.version()
        added = self.ledger.table("texts", 0) if added is None else materialize(added.select(F.col("id").cast("bigint").alias("id"), "text"), "index-texts")
        ids = added.select("id") if removed is None else added.select("id").unionByName(removed.select(F.col("id").cast("bigint").alias("id"))).distinct()
        old = materialize(self.ledger.lookup("texts", ids, version), "index-old")
        was, now = (materialize(self._grams(x), "index-grams") for x in (old, added))
        signed = was.select("gram", F.lit(-1).alias("n")).unionByName(now.select("gram", F.lit(1).alias("n"))).groupBy("gram").agg(F.sum("n").alias("d")).where("d <> 0")
        signed = materialize(signed, "index-signed")
        counts = signed.join(self.ledger.lookup("gram_counts", signed, version), "gram", "left").select("gram", (F.col("d") + F.coalesce("n", F.lit(0))).alias("n"))
        counts = materialize(counts, "index-counts")
        gone_texts = old.join(added.select("id"), "id", "left_anti")
        return self.ledger.commit(
            {"texts": added, "grams": now, "gram_counts": counts.where("n > 0")},
            {"texts": gone_texts, "grams": was.join(now, ["gram", "id"], "left_anti"), "gram_counts": counts.where("n <= 0")},
            based_on=version,
        )

    def _candidates(self, wanted: DataFrame) -> DataFrame:
        """(item_id, id) of the texts that have all of an item's chosen grams."""
        wanted = materialize(wanted, "search-grams")
        rarest = materialize(_rarest(wanted, self.ledger.lookup("gram_counts", wanted.select("gram"))), "search-rarest")
        return materialize(_candidates(rarest, self.ledger.lookup("grams", rarest.select("gram")), "id"), "search-candidates")

    def containing(self, quotes: DataFrame) -> DataFrame:
        """(item_id, id, text): all pairs of quotes(item_id, quote) and texts that hold the quote in any case."""
        low = materialize(quotes.where("quote IS NOT NULL").select("item_id", F.lower("quote").alias("quote")), "search-quotes")
        pairs = self._candidates(_of_quotes(low))
        texts = self.ledger.lookup("texts", pairs.select("id"))
        return pairs.join(low, "item_id").join(texts, "id").where(F.lower("text").contains(F.col("quote"))).select("item_id", "id", "text")

    def like(self, pattern: str) -> DataFrame:
        """(id, text) of the texts that hold a pattern in any case; % and _ are wildcards in it. A pattern of wildcards alone reads all texts."""
        parts = [p for p in re.split("[%_]+", pattern.lower()) if p]
        held = F.col("text").ilike(f"%{pattern}%")
        if not parts:
            return self.ledger.table("texts").where(held)
        spark = self.ledger.spark
        low = spark.createDataFrame(list(enumerate(parts)), "item_id int, quote string")
        found = self._candidates(_of_quotes(low)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts))
        return self.ledger.lookup("texts", materialize(found.select("id"), "search-found")).where(held)


def index_nodes(spark: SparkSession, nodes: DataFrame, path: str) -> GramIndex:
    """An index of nodes' names (at twice their id) and descriptions (one above)."""
    index = GramIndex(spark, path)
    index.change(nodes.select((F.col("id") * 2).alias("id"), F.col("name").alias("text")).unionByName(nodes.where("description IS NOT NULL").select((F.col("id") * 2 + 1).alias("id"), F.col("description").alias("text"))))
    return index


def search_nodes(index: GramIndex, nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """graph.search with an index: the newest nodes whose name or description holds the trimmed query, in any case."""
    found = index.like(query.strip()).select(F.floor(F.col("id") / 2).cast("bigint").alias("id")).distinct()
    return materialize(nodes.join(found, "id", "left_semi").orderBy(F.desc("id")).limit(limit), "search-newest")
