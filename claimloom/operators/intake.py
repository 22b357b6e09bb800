"""The whole write path: a batch of payloads folded into the graph's tables at once.

The batch's keys (documents, claims, names, ends of relations, pairs of evidence) are collected
first, and the stored graph is asked for these alone (`stored.Stored`); nothing else of it is joined,
and only what is new or changed comes out. `fold_into` does so against a bucketed ledger, where the
work follows the batch and not the store; `process` against plain tables.

A payload is a document with quoted claims, entities and relations. Replays change nothing. A
payload with a relation that lacks an end, or over a limit, is rejected as a whole; others of the
batch stay. Later payloads of a batch (by `seq`) see what earlier accepted ones bring. All
results are new tables; nothing is changed in place, so a failed batch leaves no trace. An empty
batch changes nothing. Null lists of a payload count as empty. `seq` is unique in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import RELATION_NAMES, normalized_code, quote_offsets, strip
from claimloom.operators import ingest
from claimloom.operators.stored import CLAIM_KEY, EDGE, EDGE_KEY, NODE, NODE_COLUMNS, Frames, GraphLedger, Slices, Stored, node_key, part_of
from claimloom.plans.scratch import materialize
from claimloom.sources.ledger import Conflict

PAYLOAD = (
    "seq bigint, source_project string, document_title string, document_content string, document_uri string, "
    "nodes array<struct<ref_id: string, name: string, classification: string, description: string, properties: string, existing_node_id: bigint, claim_ref: string, claim_refs: array<string>>>, "
    "edges array<struct<source_ref: string, target_ref: string, source_name: string, target_name: string, relation: string, claim_ref: string, claim_refs: array<string>>>, "
    "claims array<struct<ref_id: string, quote: string, claim_text: string, start_offset: int, end_offset: int>>"
)

TABLES = {
    "documents": "id bigint, title string, normalized_content string, source_uri string",
    "claims": "id bigint, document_id bigint, quote_text string, statement string, start_offset int, end_offset int",
    "nodes": "id bigint, name string, classification string, description string, properties string, claim_ids array<bigint>",
    "edges": "id bigint, source bigint, target bigint, relation string, claim_id bigint, claim_ids array<bigint>",
    "classifications": "id bigint, code string, display_name string",
    "relations": "id bigint, code string, display_name string",
}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


@dataclass
class Outcome:
    """tables: all tables after the batch. changes: of each table the rows that are new or changed. results: a row per payload, accepted or rejected with a reason. affected: ids of nodes that are new or changed. counters: one row of what the batch made."""

    tables: Mapping[str, DataFrame]
    changes: Mapping[str, DataFrame]
    of: Fold

    @property
    def results(self) -> DataFrame:
        return self.of.results

    @property
    def affected(self) -> DataFrame:
        return self.of.final.select("id")

    @property
    def counters(self) -> DataFrame:
        return self.of.counters


@dataclass
class Delta:
    """What a batch makes of a stored graph: new documents, claims, edges, links and codes; nodes that are new or whose own columns change, with `made`; and what Outcome says of results, affected and counters."""

    documents: DataFrame
    document_keys: DataFrame
    document_sizes: DataFrame
    claims: DataFrame
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    classifications: DataFrame
    relations: DataFrame
    results: DataFrame
    affected: DataFrame
    counters: DataFrame


@dataclass
class Known:
    """What is stored of a batch's keys: keys(seq, key, found_id) of its payloads, documents(key, document_id), claims by key, nodes by name or id. Tables without rows are so by their plan, and cost no join."""

    keys: DataFrame
    documents: DataFrame
    claims: DataFrame
    nodes: DataFrame


def _refs(one: Column, many: Column) -> Column:
    """A single reference before the list of them, without repeats."""
    return F.array_compact(F.array_distinct(F.concat(F.array(one), F.coalesce(many, F.array().cast("array<string>")))))


def _some(df: DataFrame, label: str) -> DataFrame:
    """df written; where it has no rows, joins with it fall away before they are planned."""
    written = materialize(df, label)
    return written.where("false") if written.isEmpty() else written


def _document_key() -> Column:
    return ingest.document_key(F.col("document_uri"), ingest.payload_title(), F.col("document_content"))


def prepared(payloads: DataFrame) -> DataFrame:
    """A row per payload (seq, key, nodes, edges, claims), with all that follows from the payload alone.

    Names, codes and texts are normalized. A node has the places of the claims that it refers to or
    that name it; an edge the places of the nodes at its ends, by reference and by name in any case,
    and of the claims that it cites. So references take no join: a payload's lists are searched in
    its row, and the work is the product of the lengths of its lists.
    """
    listed = lambda name: F.coalesce(F.col(name), F.array().cast(payloads.schema[name].dataType))
    start = lambda q: quote_offsets(q, F.col("document_content"))

    def claim(c: Column, pos: Column) -> Column:
        first, last = start(c["quote"])
        statement = F.when(F.coalesce(c["claim_text"], F.lit("")) == "", c["quote"]).otherwise(c["claim_text"])
        return F.struct(
            pos.alias("pos"), F.coalesce(c["ref_id"], F.concat(F.lit("c"), pos.cast("string"))).alias("ref_id"), strip(c["quote"]).alias("quote_text"), strip(statement).alias("statement"),
            F.lower(strip(c["quote"])).alias("low_quote"), F.lower(strip(statement)).alias("low_statement"),
            F.coalesce(c["start_offset"], first.cast("int")).alias("start_offset"), F.coalesce(c["end_offset"], last.cast("int")).alias("end_offset"),
        )

    def node(n: Column, pos: Column) -> Column:
        name = strip(n["name"])
        code = normalized_code(n["classification"], ingest.DEFAULT_CLASSIFICATION)
        return F.struct(pos.alias("pos"), n["ref_id"].alias("ref_id"), name.alias("name"), F.lower(name).alias("low"), code.alias("classification"), n["description"].alias("description"), n["properties"].alias("properties"), n["existing_node_id"].alias("existing"), _refs(n["claim_ref"], n["claim_refs"]).alias("claim_refs"))

    own = payloads.select("seq", _document_key().alias("key"), F.transform(listed("nodes"), node).alias("own_nodes"), listed("edges").alias("own_edges"), F.transform(listed("claims"), claim).alias("own_claims"))
    nodes, claims = F.col("own_nodes"), F.col("own_claims")
    place = lambda column, value: F.nullif(F.array_position(column, value), F.lit(0)).cast("int") - 1

    def of_node(n: Column) -> Column:
        named = lambda c: F.array_contains(n["claim_refs"], c["ref_id"]) | c["low_quote"].contains(n["low"]) | c["low_statement"].contains(n["low"])
        return F.struct(*[n[c].alias(c) for c in ("pos", "ref_id", "name", "classification", "description", "properties", "existing")], F.transform(F.filter(claims, named), lambda c: c["pos"]).alias("claims"))

    def of_edge(e: Column, pos: Column) -> Column:
        cited = F.transform(_refs(e["claim_ref"], e["claim_refs"]), lambda r, nth: F.transform(F.filter(claims, lambda c: c["ref_id"] == r), lambda c: F.struct(nth.alias("nth"), c["pos"].alias("place"))))
        ends = [e[f"{end}_{by}"].alias(f"{end}_{by}") for end in ("source", "target") for by in ("ref", "name")]
        by_ref = [place(nodes["ref_id"], e[f"{end}_ref"]).alias(f"{end}_by_ref") for end in ("source", "target")]
        by_name = [place(nodes["low"], F.lower(strip(e[f"{end}_name"]))).alias(f"{end}_by_name") for end in ("source", "target")]
        return F.struct(pos.alias("pos"), normalized_code(e["relation"], ingest.DEFAULT_RELATION).alias("relation"), *ends, *by_ref, *by_name, F.flatten(cited).alias("cited"))

    kept = F.transform(claims, lambda c: F.struct(*[c[x].alias(x) for x in ("pos", "ref_id", "quote_text", "statement", "start_offset", "end_offset")]))
    return own.select("seq", "key", F.transform(nodes, of_node).alias("nodes"), F.transform("own_edges", of_edge).alias("edges"), kept.alias("claims"))


def _nodes(batch: DataFrame) -> DataFrame:
    return batch.select("seq", F.explode("nodes").alias("n")).select("seq", "n.*")


def _edges(batch: DataFrame) -> DataFrame:
    """A row per relation, with the name and existing id of the entity at each end: of the payload, by reference or by name, or a name elsewhere."""
    nodes = F.col("nodes")

    def edge(e: Column) -> Column:
        out = [e["pos"].alias("pos"), e["relation"].alias("relation"), e["cited"].alias("cited")]
        for end in ("source", "target"):
            ref = F.get(nodes, e[f"{end}_by_ref"])
            own = F.when(ref["name"].isNotNull() | ref["existing"].isNotNull(), ref).otherwise(F.get(nodes, e[f"{end}_by_name"]))
            out += [F.when(own.isNotNull(), own["name"]).otherwise(strip(e[f"{end}_name"])).alias(f"{end}_name"), own["existing"].alias(f"{end}_existing")]
        return F.struct(*out)

    return batch.select("seq", F.explode(F.transform("edges", edge)).alias("e")).select("seq", "e.*")


def _open_edges(batch: DataFrame) -> DataFrame:
    """Relations with an end that no entity of their payload is."""
    found = lambda e, end: e[f"{end}_by_ref"].isNotNull() | e[f"{end}_by_name"].isNotNull()
    some = F.filter("edges", lambda e: ~(found(e, "source") & found(e, "target")))
    e = F.col("e")
    ends = [c for end in ("source", "target") for c in (e[f"{end}_ref"].alias(f"{end}_ref"), e[f"{end}_name"].alias(f"{end}_name"), found(e, end).alias(f"{end}_own"))]
    return batch.select("seq", F.explode(some).alias("e")).select("seq", e["pos"].alias("pos"), e["relation"].alias("relation"), *ends)


def _claims(batch: DataFrame) -> DataFrame:
    return batch.select("seq", "key", F.explode("claims").alias("c")).select("seq", "key", "c.*")


def known_of(batch: DataFrame, open_edges: DataFrame, stored: Stored) -> Known:
    """The stored rows that a batch (of prepared payloads) can touch."""
    documents = _some(stored.documents_by_key(batch.select("key").distinct()), "intake-known-documents")
    keys = batch.select("seq", "key").join(documents, "key", "left").select("seq", "key", F.col("document_id").alias("found_id"))
    of_stored = _claims(batch).join(documents, "key").select(*CLAIM_KEY).distinct()
    claims = _some(stored.claims_by_key(of_stored), "intake-known-claims")
    ends = open_edges.select(F.explode(F.array(strip(F.col("source_name")), strip(F.col("target_name")))).alias("name"))
    nodes = _nodes(batch)
    names = nodes.select("name").distinct().unionByName(ends).where("name IS NOT NULL").distinct()
    ids = nodes.where("existing IS NOT NULL").select(F.col("existing").alias("id")).distinct()
    return Known(keys, documents, claims, _some(stored.nodes_named(names, ids), "intake-known-nodes"))


def _unresolved(open_edges: DataFrame, named: DataFrame, stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """(seq, reason) of accepted payloads with an end that is no reference or name of theirs, no stored name, and no name of an earlier accepted payload. named(name, seq): who brings the names that are asked for."""
    own = named.join(accepted, "seq", "left_semi")
    known = stored.select("name", F.lit(-1).cast("bigint").alias("since")).unionByName(own.groupBy("name").agg(F.min("seq").alias("since"))).groupBy("name").agg(F.min("since").alias("since"))
    out = open_edges.join(accepted, "seq", "left_semi")
    for end in ("source", "target"):
        far = known.select(F.col("name").alias("exact"), "since")
        x = out.withColumn("exact", strip(F.col(f"{end}_name"))).join(far, "exact", "left")
        out = x.withColumn(f"{end}_ok", F.col(f"{end}_own") | F.coalesce(F.col("since") < F.col("seq"), F.lit(False))).drop("exact", "since")
    missing = F.concat_ws(", ", F.when(~F.col("source_ok"), F.coalesce("source_name", "source_ref")), F.when(~F.col("target_ok"), F.coalesce("target_name", "target_ref")))
    return out.where("NOT (source_ok AND target_ok)").groupBy("seq").agg(F.min_by(F.concat(F.lit("unresolved end of "), "relation", F.lit(": "), missing), "pos").alias("reason"))


def _over_claims(known: Known, claims: DataFrame, counts: DataFrame, accepted: DataFrame, most: int) -> DataFrame:
    """(seq, reason) of the first accepted payload of each document that gets more claims than `most`. claims: new ones, each with its first payloads first."""
    live = claims.join(accepted, "seq", "left_semi")
    first = live.groupBy("key", "found_id", "quote_text", "statement").agg(F.min("seq").alias("seq"))
    per = first.groupBy("key", "found_id", "seq").agg(F.count("*").alias("n"))
    so_far = per.withColumn("n", F.sum("n").over(Window.partitionBy("key").orderBy("seq"))).join(counts.withColumnRenamed("document_id", "found_id"), "found_id", "left")
    beyond = so_far.where(F.col("n") + F.coalesce("n_old", F.lit(0)) > most).groupBy("key").agg(F.min("seq").alias("seq"))
    return beyond.select("seq", F.lit(f"more than {most} claims of a document").alias("reason"))


def _over_documents(known: Known, room: int, accepted: DataFrame, most: int) -> DataFrame:
    """(seq, reason) of accepted payloads whose new document doesn't fit any more."""
    new = known.keys.join(accepted, "seq", "left_semi").where("found_id IS NULL")
    fits = new.groupBy("key").agg(F.min("seq").alias("since")).orderBy("since").limit(room).select("key")
    return new.join(fits, "key", "left_anti").select("seq", F.lit(f"more than {most} documents").alias("reason"))


def accept(batch: DataFrame, open_edges: DataFrame, known: Known, stored: Stored, most_documents: int | None = None, most_claims: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(accepted seqs, or None for all; (seq, reason) of rejected payloads). Rejecting one may take another's names away, so this goes on until nothing changes."""
    accepted = batch.select("seq")
    asked = open_edges.select(F.explode(F.array(strip(F.col("source_name")), strip(F.col("target_name")))).alias("name")).distinct()
    named = _some(_nodes(batch).select("name", "seq").join(asked, "name", "left_semi").distinct(), "intake-named")
    counts = claims = None
    if most_claims is not None:
        found = known.keys.where("found_id IS NOT NULL").select(F.col("found_id").alias("document_id")).distinct()
        counts = _some(stored.claim_counts(found), "intake-claim-counts")
        with_found = _claims(batch).join(known.documents, "key", "left")
        unknown = with_found.join(known.claims, CLAIM_KEY, "left_anti")
        claims = materialize(unknown.groupBy("key", F.col("document_id").alias("found_id"), "quote_text", "statement", "seq").agg(F.min("pos").alias("pos")), "intake-new-claims")
    room = None if most_documents is None else max(most_documents - stored.n_documents(), 0)
    rejected, changed = None, False
    while True:
        bad = _unresolved(open_edges, named, known.nodes, accepted)
        if counts is not None:
            bad = bad.unionByName(_over_claims(known, claims, counts, accepted, most_claims))
        bad = _some(bad.groupBy("seq").agg(F.min("reason").alias("reason")), "intake-rejected")
        if room is not None and bad.isEmpty():  # rejected payloads take no room
            bad = _some(_over_documents(known, room, accepted, most_documents), "intake-rejected")
        rejected = bad if rejected is None else rejected.unionByName(bad)
        if bad.isEmpty():
            return accepted if changed else None, rejected
        accepted, changed = materialize(accepted.join(bad, "seq", "left_anti"), "intake-accepted"), True


def _json_object(pairs: Column) -> Column:
    """JSON text of structs (key, value), values JSON texts, by key."""
    quoted = lambda k: F.concat(F.lit('"'), F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quoted(p["key"]), p["value"])), ","), F.lit("}"))


def merged_properties(rows: DataFrame) -> DataFrame:
    """(node_id, properties) of all patches rows(node_id, properties, seq, pos, creates), in order of (seq, pos).

    The first value of a key stays; a null creates none, except in the patch that creates the
    node. A key of ingest.MERGED whose value is an object is merged key by key, the last value
    winning, null too, and an empty object is one; objects replace a plain value of that key, and
    plain values don't replace an object. Properties that are no JSON object say nothing.
    """
    order = F.struct("seq", "pos")
    top = rows.select("node_id", "seq", "pos", "creates", F.explode(F.from_json("properties", "map<string, variant>")).alias("key", "v")).withColumn("value", F.to_json("v")).drop("v")
    deep = F.col("key").isin(*ingest.MERGED) & F.col("value").startswith("{")
    plain = top.where(~deep & (F.col("creates") | (F.col("value") != "null"))).groupBy("node_id", "key").agg(F.min_by("value", order).alias("plain"))
    inside = top.where(deep).select("node_id", F.col("key").alias("group"), F.explode_outer(F.from_json("value", "map<string, variant>")).alias("key", "v"), "seq", "pos")
    last = inside.withColumn("value", F.to_json("v")).groupBy("node_id", "group", "key").agg(F.max_by("value", order).alias("value"))
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    objects = last.groupBy("node_id", "group").agg(_json_object(pairs).alias("object")).withColumnRenamed("group", "key")
    both = plain.join(objects, ["node_id", "key"], "full").select("node_id", "key", F.coalesce("object", "plain").alias("value"))
    return both.groupBy("node_id").agg(_json_object(F.collect_list(F.struct("key", "value"))).alias("properties"))


class Fold:
    """Payloads (schema PAYLOAD) folded into a stored graph, step by step as results ask for it; each step is done once.

    most_documents: documents that the store may hold; most_claims: claims that a document may
    have. A payload beyond a limit is rejected, with the reason. Without limits none is.
    """

    def __init__(self, payloads: DataFrame, stored: Stored, most_documents: int | None = None, most_claims: int | None = None):
        self.payloads, self.stored = payloads, stored
        self.batch = batch = materialize(prepared(payloads), "intake-batch")
        open_edges = _some(_open_edges(batch), "intake-open-edges")
        self.known = known_of(batch, open_edges, stored)
        self.accepted, self.rejected = accept(batch, open_edges, self.known, stored, most_documents, most_claims)
        self.live = batch if self.accepted is None else materialize(batch.join(self.accepted, "seq", "left_semi"), "intake-live")

    # Documents: a new one for each key that is not stored.

    @cached_property
    def made(self) -> DataFrame:
        """(key, at, id): new documents, with the payload that brings each."""
        new = self.live.select("seq", "key").join(self.known.documents, "key", "left_anti")
        return materialize(ingest.ids_after(new.groupBy("key").agg(F.min("seq").alias("at")), self.stored.top("documents"), ["at"]), "intake-documents")

    @cached_property
    def document_of(self) -> DataFrame:
        """(key, document_id) of all accepted payloads' keys."""
        return self.known.documents.select("key", "document_id").unionByName(self.made.select("key", F.col("id").alias("document_id")))

    @cached_property
    def documents(self) -> DataFrame:
        rows = self.payloads.select(F.col("seq").alias("at"), ingest.payload_title().alias("title"), F.col("document_content").alias("normalized_content"), F.nullif("document_uri", F.lit("")).alias("source_uri"))
        return rows.join(self.made, "at").select("id", "title", "normalized_content", "source_uri")

    # Claims: a new one for each (document, quote, statement) that is not stored.

    @cached_property
    def found(self) -> DataFrame:
        """A row per incoming claim, with the first place (at_seq, at_pos) of its key and the stored claim; new claims have their text there. Rows of one key are sorted, not held, by a task."""
        incoming = self.live.select("seq", "key", "claims").join(self.document_of, "key").select("seq", "document_id", F.explode("claims").alias("c"))
        incoming = incoming.select("seq", "c.pos", "document_id", "c.quote_text", "c.statement", "c.start_offset", "c.end_offset")
        first = F.first(F.struct("seq", "pos")).over(Window.partitionBy(*CLAIM_KEY).orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        x = incoming.withColumn("at", first).join(self.known.claims.select(*CLAIM_KEY, "claim_id"), CLAIM_KEY, "left")
        new = (F.col("at") == F.struct("seq", "pos")) & F.col("claim_id").isNull()
        x = x.select("*", new.alias("is_new"), (F.col("quote_text").isNotNull() & F.col("statement").isNotNull()).alias("whole"))
        return materialize(x.select("seq", "pos", F.col("at.seq").alias("at_seq"), F.col("at.pos").alias("at_pos"), "claim_id", "is_new", "whole", *[F.when(F.col("is_new"), F.col(c)).alias(c) for c in (*CLAIM_KEY, "start_offset", "end_offset")]), "intake-found-claims")

    @cached_property
    def claims(self) -> DataFrame:
        new = self.found.where("is_new").select(*CLAIM_KEY, "start_offset", "end_offset", "at_seq", "at_pos")
        return ingest.ids_after(new, self.stored.top("claims"), ["at_seq", "at_pos"])

    @cached_property
    def claim_of(self) -> DataFrame:
        """(seq, place, claim_id) of every incoming claim with a quote. New ones are numbered as `claims` does, without their text."""
        new = self.found.where("is_new").select("at_seq", "at_pos")
        ids = ingest.ids_after(new, self.stored.top("claims"), ["at_seq", "at_pos"]).withColumnRenamed("id", "new_id")
        x = self.found.where("whole").select("seq", F.col("pos").alias("place"), "at_seq", "at_pos", "claim_id").join(ids, ["at_seq", "at_pos"], "left")
        return materialize(x.select("seq", "place", F.coalesce("claim_id", "new_id").alias("claim_id")), "intake-claim-refs")

    @cached_property
    def document_sizes(self) -> DataFrame:
        grown = self.found.where("is_new").groupBy("document_id").agg(F.count("*").alias("n"))
        return grown.join(self.stored.claim_counts(grown.select("document_id")), "document_id", "left").select("document_id", (F.col("n") + F.coalesce("n_old", F.lit(0))).alias("n_claims"))

    # Entities.

    @cached_property
    def entities(self) -> DataFrame:
        """(name, existing, at, classification): entities as payloads mean them, with the first place of each."""
        at = F.struct("seq", "pos")
        return materialize(_nodes(self.live).groupBy("name", "existing").agg(F.min(at).alias("at"), F.min_by("classification", at).alias("classification")), "intake-entities")

    @cached_property
    def by_id(self) -> DataFrame | None:
        """(id_key, id_hit) of stored ids that payloads name, if they name any."""
        if self.entities.where("existing IS NOT NULL").isEmpty():
            return None
        return self.known.nodes.select(F.col("id").alias("id_key"), F.col("id").alias("id_hit")).distinct()

    @cached_property
    def made_nodes(self) -> DataFrame:
        x = self.entities.join(ingest.newest_by_name(self.known.nodes).withColumnRenamed("id", "name_hit"), "name", "left")
        if self.by_id is not None:
            x = x.join(self.by_id, F.col("existing") == F.col("id_key"), "left").withColumn("name_hit", F.coalesce("id_hit", "name_hit"))
        new = x.where("name_hit IS NULL").groupBy("name").agg(F.min("at").alias("at"), F.min_by("classification", "at").alias("classification"))
        return materialize(ingest.ids_after(new, self.stored.top("nodes"), ["at"]), "intake-nodes")

    @cached_property
    def base(self) -> DataFrame:
        """All nodes that the batch touches or makes, as stored."""
        none = F.lit(None).cast("string")
        new = self.made_nodes.select("id", "name", "classification", none.alias("description"), none.alias("properties"), F.lit(True).alias("made"))
        return self.known.nodes.withColumn("made", F.lit(False)).unionByName(new)

    @cached_property
    def by_name(self) -> DataFrame:
        return materialize(ingest.newest_by_name(self.base).select(F.col("name").alias("name_key"), F.col("id").alias("name_hit")), "intake-names")

    def located(self, rows: DataFrame, out: str, name: str = "name", existing: str = "existing") -> DataFrame:
        """rows with the id of the entity that (name, existing) means, in their place: the stored one, else the newest of that name."""
        kept = [c for c in rows.columns if c not in (name, existing)]
        x = rows.join(self.by_name, F.col(name) == F.col("name_key"), "left")
        found = F.col("name_hit")
        if self.by_id is not None:
            x = x.join(self.by_id, F.col(existing) == F.col("id_key"), "left")
            found = F.coalesce("id_hit", "name_hit")
        return x.select(*kept, found.alias(out))

    # Relations: a new edge for each (source, target, relation) that is not stored.

    @cached_property
    def with_claims(self) -> DataFrame:
        """(seq, pos, nth, source, target, relation, claim_id): a row per relation and claim that it cites, or without one."""
        rows = self.located(_edges(self.live), "source", "source_name", "source_existing")
        rows = self.located(rows, "target", "target_name", "target_existing")
        cited = rows.select("seq", "pos", "source", "target", "relation", F.explode_outer("cited").alias("c")).select("seq", "pos", "source", "target", "relation", "c.nth", "c.place")
        return materialize(cited.join(self.claim_of, ["seq", "place"], "left"), "intake-relations")

    @cached_property
    def merged(self) -> DataFrame:
        first = F.when(F.col("claim_id").isNotNull(), F.struct("seq", "pos", "nth", "place"))
        merged = self.with_claims.groupBy(*EDGE_KEY).agg(F.min_by("claim_id", first).alias("claim_id"))
        return materialize(merged.join(self.stored.edges_by_key(merged.select(*EDGE_KEY)), EDGE_KEY, "left"), "intake-edges")

    @cached_property
    def made_edges(self) -> DataFrame:
        return ingest.ids_after(self.merged.where("edge_id IS NULL").drop("edge_id"), self.stored.top("edges"), EDGE_KEY)

    # Evidence: links of entities and edges to claims, those that aren't stored.

    @cached_property
    def evidence(self) -> DataFrame:
        own = self.live.select("seq", F.explode("nodes").alias("n"))
        hits = own.select("seq", "n.name", "n.existing", F.explode("n.claims").alias("place"))
        # All claims of a payload for its only entity, if that has none.
        names = F.array_distinct(F.filter(F.col("nodes")["name"], lambda x: x.isNotNull()))
        bare = ~F.exists("nodes", lambda n: F.size(n["claims"]) > 0) & ((F.size(names) <= 1) | F.exists("nodes", lambda n: n["existing"].isNotNull()))
        lone = self.live.where(bare & (F.size("claims") > 0)).select("seq", F.col("claims")["pos"].alias("places"), F.explode("nodes").alias("n")).select("seq", "places", "n.name", "n.existing")
        lone = self.located(lone, "owner_id").groupBy("seq").agg(F.countDistinct("owner_id").alias("n"), F.max("owner_id").alias("owner_id"), F.first("places").alias("places"))
        lone = lone.where("n = 1").select("seq", F.explode("places").alias("place"), "owner_id")
        attributed = self.located(hits, "owner_id").unionByName(lone).join(self.claim_of, ["seq", "place"]).select("owner_id", "claim_id")
        cited = self.with_claims.where("claim_id IS NOT NULL")
        through = cited.select(F.explode(F.array("source", "target")).alias("owner_id"), "claim_id")
        edge_of = self.merged.select(*EDGE_KEY, F.col("edge_id").alias("owner_id")).where("owner_id IS NOT NULL").unionByName(self.made_edges.select(*EDGE_KEY, F.col("id").alias("owner_id")))
        of_edges = cited.join(edge_of, EDGE_KEY).select(F.lit(EDGE).alias("kind"), "owner_id", "claim_id")
        links = attributed.unionByName(through).select(F.lit(NODE).alias("kind"), "owner_id", "claim_id").unionByName(of_edges).distinct()
        links = materialize(links, "intake-links")
        new = self.stored.without_evidence(links)
        return links if new is links else materialize(new, "intake-evidence")

    # What entities gather besides: descriptions and properties.

    @cached_property
    def final(self) -> DataFrame:
        nodes, base = _nodes(self.live), self.base
        told = self.located(nodes.where("description <> ''").select("seq", "pos", "name", "existing", "description"), "node_id")
        described = ingest.last_descriptions(told).select(F.col("node_id").alias("id"), F.col("description").alias("new_description"))
        said = _some(self.located(nodes.where("properties IS NOT NULL").select("seq", "pos", "name", "existing", "properties"), "node_id"), "intake-properties")
        first = self.located(self.entities.select("name", "existing", "at"), "node_id").groupBy("node_id").agg(F.min("at").alias("first_at"))
        created = said.join(first, "node_id").join(base.where("made").select(F.col("id").alias("node_id"), "made"), "node_id", "left")
        patches = created.select("node_id", "properties", "seq", "pos", (F.coalesce("made", F.lit(False)) & (F.struct("seq", "pos") == F.col("first_at"))).alias("creates"))
        old = base.where("properties IS NOT NULL").select(F.col("id").alias("node_id"), "properties", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("pos"), F.lit(True).alias("creates")).join(said.select("node_id").distinct(), "node_id", "left_semi")
        props = merged_properties(old.unionByName(patches)).select(F.col("node_id").alias("id"), F.col("properties").alias("new_properties"))
        grew = self.evidence.where(F.col("kind") == NODE).select(F.col("owner_id").alias("id")).distinct().withColumn("grew", F.lit(True))
        x = base.join(described, "id", "left").join(props, "id", "left").join(grew, "id", "left")
        differs = lambda new, was: F.coalesce(F.col(new).isNotNull() & ~was(F.col(new)).eqNullSafe(was(F.col(new[4:]))), F.lit(False))
        rewritten = F.col("made") | differs("new_description", lambda c: c) | differs("new_properties", lambda c: F.to_json(F.parse_json(c)))
        final = x.select("id", "name", "classification", F.coalesce("new_description", "description").alias("description"), F.coalesce("new_properties", "properties").alias("properties"), "made", rewritten.alias("rewritten"), F.coalesce("grew", F.lit(False)).alias("grew"))
        return materialize(final.where("rewritten OR grew"), "intake-final")

    def new_codes(self, name: str, codes: Column, display: dict[str, str]) -> DataFrame:
        codes = materialize(self.live.select(F.explode(codes).alias("code")).distinct(), "intake-codes")
        missing = ingest.new_codes(codes, self.stored.codes(name, codes), names=display)
        return materialize(ingest.ids_after(missing, self.stored.top(name), ["code"]).select("id", "code", "display_name"), "intake-codes")

    @cached_property
    def classifications(self) -> DataFrame:
        return self.new_codes("classifications", F.col("nodes")["classification"], ingest.CLASSIFICATION_NAMES)

    @cached_property
    def relations(self) -> DataFrame:
        return self.new_codes("relations", F.col("edges")["relation"], RELATION_NAMES)

    @cached_property
    def results(self) -> DataFrame:
        nodes = F.col("nodes")
        chosen = F.coalesce(F.get(F.filter(nodes, lambda n: n["ref_id"].isNotNull()), F.lit(0)), F.get(nodes, F.lit(0)))
        primary = self.located(self.live.select("seq", "key", chosen.alias("n")).select("seq", "key", "n.name", "n.existing"), "primary_node_id")
        known = primary.join(self.document_of, "key", "left").select("seq", "document_id", "primary_node_id")
        if self.accepted is None:
            return known.select("seq", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"), "document_id", "primary_node_id")
        return self.batch.select("seq").join(self.rejected, "seq", "left").join(known, "seq", "left").select("seq", F.col("reason").isNull().alias("accepted"), "reason", "document_id", "primary_node_id")

    @cached_property
    def counters(self) -> DataFrame:
        new = F.count_if("is_new")
        seen = self.found.agg(new.alias("claims_created"), (F.count("*") - new).alias("claims_reused"))
        one = lambda df, column: df.agg(F.count("*").alias(column))
        parts = [one(self.made, "documents_created"), seen, one(self.made_nodes, "nodes_created"), one(self.merged.where("edge_id IS NULL"), "edges_created")]
        names = ["documents_created", "claims_created", "claims_reused", "nodes_created", "edges_created"]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def fold(payloads: DataFrame, stored: Stored, most_documents: int | None = None, most_claims: int | None = None) -> Delta:
    """Fold payloads (schema PAYLOAD) into a stored graph, with Fold's limits."""
    f = Fold(payloads, stored, most_documents, most_claims)
    documents = materialize(f.documents, "intake-documents")
    keys = documents.select(F.explode(ingest.stored_keys()).alias("key"), F.col("id").alias("document_id")).where("key IS NOT NULL")
    return Delta(
        documents, keys, f.document_sizes, f.claims.select("id", *CLAIM_KEY, "start_offset", "end_offset"),
        f.final.where("rewritten").select(*NODE_COLUMNS, "made"), f.made_edges.select("id", *EDGE_KEY, "claim_id"), f.evidence,
        f.classifications, f.relations, f.results, f.final.select("id"), f.counters,
    )


class Tables(Mapping):
    """Tables by name, each made when it is asked for."""

    def __init__(self, make: Callable[[str], DataFrame]):
        self.make = cache(make)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.make(name)

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def process(payloads: DataFrame, stored: dict[str, DataFrame], most_documents: int | None = None, most_claims: int | None = None) -> Outcome:
    """Fold payloads (schema PAYLOAD) into plain tables (schemas TABLES), with Fold's limits. Lists of claims are made of the evidence that a batch brings. Nothing is stored, so only what is read of the outcome is worked out."""
    frames = Frames.of(stored)
    stored = frames.tables
    f = Fold(payloads, frames, most_documents, most_claims)

    def listed(kind: str, name: str) -> DataFrame:
        rows = f.final.where("rewritten").select(*NODE_COLUMNS) if kind == NODE else f.made_edges.select("id", *EDGE_KEY, "claim_id")
        links = f.evidence.where(F.col("kind") == kind).select(F.col("owner_id").alias("id"), "claim_id")
        touched = rows.select("id").unionByName(links.select("id")).distinct()
        old = stored[name].join(touched, "id", "left_semi")
        held = old.select("id", F.col("claim_ids").alias("claim_ids"))
        base = rows.join(held, "id", "left").unionByName(old.join(rows, "id", "left_anti"))
        return materialize(ingest.union_evidence(base, links).drop("affected").select(*stored[name].columns), f"intake-{name}")

    def change(name: str) -> DataFrame:
        if name in ("nodes", "edges"):
            return listed(NODE if name == "nodes" else EDGE, name)
        rows = getattr(f, name)
        return rows.select(*stored[name].columns)

    changes = Tables(change)
    tables = Tables(lambda name: (stored[name].join(changes[name], "id", "left_anti") if name in ("nodes", "edges") else stored[name]).unionByName(changes[name]))
    return Outcome(tables, changes, f)


def rows_of(delta: Delta) -> dict[str, DataFrame]:
    """Rows of a delta for the tables of a graph's ledger, indexes included."""
    ends = delta.edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id"), F.col("id").alias("edge_id"), *EDGE_KEY)
    return {
        "documents": delta.documents, "document_keys": delta.document_keys, "document_sizes": delta.document_sizes, "claims": delta.claims,
        "nodes": delta.nodes, "node_names": delta.nodes.where("made").select("id", "name"), "node_keys": delta.nodes.where("made").select(node_key(F.col("name")).alias("low"), "id"), "edges": delta.edges, "edge_ends": ends,
        "evidence": delta.evidence, "evidence_by_owner": delta.evidence.withColumn("part", part_of(F.col("claim_id"))),
        "classifications": delta.classifications, "relations": delta.relations,
    }


def fold_into(payloads: DataFrame, ledger: GraphLedger, source: str | None = None, batch: int | None = None, most_documents: int | None = None, most_claims: int | None = None, attempts: int = 5, rules: list | None = None) -> Delta | None:
    """Fold payloads into a ledger in one commit. If another writer commits meanwhile, the batch is folded again into what there is then.

    None if the source has committed this batch before.
    """
    for left in range(attempts - 1, -1, -1):
        version = ledger.version()
        if source is not None and ledger.has(source, batch, version):
            return None
        delta = fold(payloads, Slices(ledger, version), most_documents, most_claims)
        try:
            ledger.commit(rows_of(delta), based_on=version, source=source, batch=batch, live={"documents": delta.documents.count()}, rules=rules)
            return delta
        except Conflict:
            if not left:
                raise
    return None


def ledger_of(tables: dict[str, DataFrame], ledger: GraphLedger, links: DataFrame | None = None) -> int:
    """Put plain tables (schemas TABLES) into an empty ledger; returns the version. links(kind, owner_id, claim_id): the evidence, in place of the lists in nodes and edges."""
    # Each goes into several tables, and is counted before it is written.
    nodes, edges = materialize(tables["nodes"], "ledger-nodes"), materialize(tables["edges"], "ledger-edges")
    if links is None:
        of = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("id").alias("owner_id"), F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
        links = of(NODE, nodes).unionByName(of(EDGE, edges))
    documents = tables["documents"]
    keys = documents.select(F.explode(ingest.stored_keys()).alias("key"), F.col("id").alias("document_id")).where("key IS NOT NULL").distinct()
    sizes = tables["claims"].groupBy("document_id").agg(F.count("*").alias("n_claims"))
    made = nodes.select(*NODE_COLUMNS).withColumn("made", F.lit(True))
    none = ledger.spark.createDataFrame([], "seq bigint")  # what only a batch has
    delta = Delta(documents, keys, sizes, tables["claims"], made, edges.select("id", *EDGE_KEY, "claim_id"), links, tables["classifications"], tables["relations"], none, none, none)
    return ledger.commit(rows_of(delta), based_on=0, live={"documents": documents.count()})
