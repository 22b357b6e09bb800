"""Rules that extracted entities, relations and claims must satisfy to be admitted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import STOP_WORDS, blank, json_object, quote_offsets, strip
from claimloom.operators import grams
from claimloom.operators.order import fresh
from claimloom.plans.scratch import materialize

#: Words of the windows that passages and texts are joined on; powers of two.
WINDOWS = (1, 2, 4, 8)

EXTRACTION = (
    "nodes array<struct<name: string, classification: string, description: string, properties: string>>, "
    "edges array<struct<source_name: string, target_name: string, relation: string>>, "
    "claims array<struct<quote: string, claim_text: string, confidence: double>>, "
    "insights struct<summary: string>"
)


def too_long(content: Column, most: int) -> Column:
    """Whether a content has more than `most` characters; null has none."""
    return F.coalesce(F.length(content) > most, F.lit(False))


def decode_responses(rows: DataFrame, raw: str = "raw_response") -> DataFrame:
    """rows with `extracted`, the decoded response; null where it is no JSON object."""
    return rows.withColumn("extracted", json_object(F.col(raw), EXTRACTION))


def claims_of(decoded: DataFrame) -> DataFrame:
    """(doc_id, pos, ref, quote, claim_text, start, end): one row per extracted claim, its quote stripped, with its place in the content; the text defaults to the quote."""
    rows = decoded.select("doc_id", "content", F.posexplode("extracted.claims").alias("pos", "c")).withColumn("quote", F.coalesce(strip(F.col("c.quote")), F.lit("")))
    start, end = quote_offsets(F.nullif("quote", F.lit("")), F.col("content"))
    text = F.when(F.coalesce("c.claim_text", F.lit("")) == "", F.col("quote")).otherwise(F.col("c.claim_text"))
    return rows.select("doc_id", "pos", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("ref"), "quote", text.alias("claim_text"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _windows(words: str, widths: list[int], skip: int) -> Column:
    """Distinct hashes of the runs of so many words, without `skip` words at either end."""
    of = lambda k: F.when(F.size(words) >= k + 2 * skip, F.transform(F.sequence(F.lit(1 + skip), F.size(words) - k + 1 - skip), lambda i: F.xxhash64(F.lit(k), F.slice(words, i, k))))
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(of(k), F.array().cast("array<bigint>")) for k in widths])))


def passages_in(passages: DataFrame, texts: DataFrame, any_case: bool = False) -> DataFrame:
    """(doc_id, item_id, quote, text): all pairs of passages(item_id, quote) and texts(doc_id, text) where the text holds the quote.

    A text that holds a quote has the quote's words in a row, but for the first and last, which it
    may have parts of. So both are joined on hashes of runs of words, each passage on the run
    that fewest texts have, and only these pairs are tested. Quotes of two words or fewer have
    no whole word inside; they are joined on runs of characters (see grams). An empty quote is in no
    text. Rows with equal ids stand for one.
    """
    fold = F.lower if any_case else (lambda c: c)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    items = passages.where("quote IS NOT NULL AND item_id IS NOT NULL").dropDuplicates(["item_id"]).withColumn("w", words(F.col("quote")))
    width = F.array_max(F.filter(F.array(*[F.lit(k) for k in WINDOWS]), lambda k: k <= F.size("w") - 2))
    items = materialize(items.select("item_id", "quote", "w", width.alias("width")), "passages")
    widths = sorted(r[0] for r in items.where("width IS NOT NULL").select("width").distinct().collect())
    docs = texts.where("text IS NOT NULL AND doc_id IS NOT NULL")
    holds = fold(F.col("text")).contains(fold(F.col("quote")))
    short = items.where("width IS NULL AND quote <> ''").select("item_id", fold(F.col("quote")).alias("quote"))
    parts = [] if short.isEmpty() else [grams.candidates(short, docs.dropDuplicates(["doc_id"]).select("doc_id", fold(F.col("text")).alias("text"))).select("doc_id", "item_id")]
    if widths:
        runs = reduce(DataFrame.unionByName, [items.where(F.col("width") == k).select("item_id", F.explode(_windows("w", [k], 1)).alias("run")) for k in widths])
        runs = materialize(runs, "passage-runs")
        seen = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(_windows("w", widths, 0)).alias("run"))
        seen = materialize(seen.join(runs.select("run").distinct(), "run", "left_semi"), "passage-seen")
        count = materialize(seen.groupBy("run").agg(F.count("*").alias("n")), "passage-counts")
        rarest = runs.join(count, "run", "left").groupBy("item_id").agg(F.min_by(F.struct("run", "n"), F.struct(F.coalesce("n", F.lit(0)), "run")).alias("r"))
        rarest = materialize(rarest.where("r.n > 0").select("item_id", F.col("r.run").alias("run")), "passage-rarest")
        parts.append(seen.join(rarest, "run").select("doc_id", "item_id"))
    if not parts:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", "quote", "text")
    pairs = materialize(reduce(DataFrame.unionByName, parts).distinct(), "passage-pairs")
    return pairs.join(items.select("item_id", "quote"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(holds).select("doc_id", "item_id", "quote", "text")


def _claim_text() -> Column:
    return F.lower(F.concat("quote", F.lit(" "), F.coalesce("claim_text", F.lit(""))))


def tokens(name: Column) -> Column:
    """Words of a name, of two characters or more, that aren't stop words."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9가-힣]+)"), 1)
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def pairs_of_characters(name: Column) -> Column:
    """Two-character substrings of a name without stop words among them."""
    low = F.lower(strip(name))
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, 2))
    return F.filter(F.array_distinct(all_), lambda s: (F.length(s) == 2) & ~s.isin(*STOP_WORDS))


def grounding_level(name: Column, text: Column) -> Column:
    """1 if the claim holds the name or the name the claim, 2 if it holds a word of the name, 3 if two characters of it; else null."""
    low = F.lower(strip(name))
    return (
        F.when(text.contains(low) | low.contains(text), 1)
        .when(F.exists(tokens(name), lambda w: text.contains(w)), 2)
        .when(F.exists(pairs_of_characters(name), lambda w: text.contains(w)), 3)
    )


def ground_entities(entities: DataFrame, claims: DataFrame, most: int | None = None) -> DataFrame:
    """entities(doc_id, pos, name) that their document's claims support, with level, refs, and a dense ref; at most `most` of a document, by pos, if given.

    The best level of any claim counts, and the refs are of claims at that level. A document
    without claims supports all its entities. Blank names go; (doc_id, pos) is unique.
    """
    entities = entities.where(~blank(F.col("name"))).withColumn("name", strip(F.col("name")))
    tested = entities.join(claims.select("doc_id", F.col("pos").alias("claim_pos"), "ref", _claim_text().alias("text")), "doc_id", "left")
    tested = tested.withColumn("level", F.when(F.col("ref").isNull(), 0).otherwise(grounding_level(F.col("name"), F.col("text"))))
    by_level = tested.where("level IS NOT NULL").groupBy("doc_id", "pos", "name", "level").agg(F.array_sort(F.collect_list(F.struct("claim_pos", "ref"))).alias("found"))
    best = by_level.groupBy("doc_id", "pos", "name").agg(F.min("level").alias("level"), F.min_by("found", "level").alias("found"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = best.withColumn("n", F.row_number().over(order)).where(F.lit(True) if most is None else F.col("n") <= most)
    return kept.select("doc_id", "pos", "name", "level", F.array_compact(F.col("found.ref")).alias("claim_refs"), F.concat(F.lit("n"), (F.col("n") - 1).cast("string")).alias("ref_id"))


def admit_edges(edges: DataFrame, kept: DataFrame, known: DataFrame) -> DataFrame:
    """edges(doc_id, pos, source_name, target_name, relation) whose ends are kept entities of the document or known names, in any case."""
    own = kept.select("doc_id", F.lower(strip(F.col("name"))).alias("name")).distinct()
    stored = known.select(F.lower(strip(F.col("name"))).alias("name")).distinct()
    end_name, is_own, is_known = (fresh(edges, x) for x in ("end_name", "is_own", "is_known"))
    out = edges
    for end in ("source", "target"):
        e = out.withColumn(end_name, F.lower(strip(F.col(f"{end}_name"))))
        a = own.select("doc_id", F.col("name").alias(end_name), F.lit(True).alias(is_own))
        b = stored.select(F.col("name").alias(end_name), F.lit(True).alias(is_known))
        out = e.join(a, ["doc_id", end_name], "left").join(b, end_name, "left").where(F.col(is_own) | F.col(is_known)).drop(end_name, is_own, is_known)
    return out


def attribute_edges(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """edges with `claim_ref`: the first claim that names both ends, else the target, else the source, else the document's first."""
    pairs = edges.select("doc_id", "pos", F.lower(strip(F.col("source_name"))).alias("s"), F.lower(strip(F.col("target_name"))).alias("t"))
    pairs = pairs.join(claims.select("doc_id", F.col("pos").alias("claim_pos"), "ref", _claim_text().alias("text")), "doc_id", "left")
    s, t = F.col("text").contains(F.col("s")), F.col("text").contains(F.col("t"))
    priority = F.when(s & t, 0).when(t, 1).when(s, 2).otherwise(3)
    best = pairs.groupBy("doc_id", "pos").agg(F.min_by("ref", F.struct(priority.alias("p"), "claim_pos")).alias("claim_ref"), F.min(F.when(F.col("ref").isNotNull(), priority)).alias("priority"))
    return edges.join(best, ["doc_id", "pos"])


def insight_rows(responses: DataFrame, most_issues: int | None = None, most_questions: int | None = None) -> DataFrame:
    """(node_id, issues, questions) of responses(node_id, issues, questions), cut to the first of each if limits are given; pairs with a blank side go, the sequence is the original place. Null lists are empty."""
    cut = lambda a, n: a if n is None else F.slice(a, 1, n)
    asked = cut(F.coalesce("questions", F.array().cast("array<struct<question: string, answer: string>>")), most_questions)
    live = F.filter(F.transform(asked, lambda q, i: F.struct(i.alias("sequence"), strip(q["question"]).alias("question"), strip(q["answer"]).alias("answer"))), lambda q: (q["question"] != "") & (q["answer"] != ""))
    return responses.select("node_id", cut(F.coalesce("issues", F.array().cast("array<string>")), most_issues).alias("issues"), live.alias("questions"))


def without_evidence(claim_ids: Column, description: Column) -> Column:
    """Whether there is nothing to derive an insight from."""
    return (F.size(F.coalesce(claim_ids, F.array().cast("array<bigint>"))) == 0) & (F.coalesce(description, F.lit("")) == "")
