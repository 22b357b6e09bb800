"""Idempotent, set-based ingest: documents, claims, entities and relations from payload rows.

Every operator works on all payloads of a batch at once. Order, where it matters, is the column
`seq` (arrival) and `pos` (place in the payload); ids of new rows are max(id) + row number over
that order. References are local to a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import CLASSIFICATION_NAMES, capitalized, normalized_code, strip
from claimloom.operators.order import fresh, row_numbers

DEFAULT_CLASSIFICATION, DEFAULT_RELATION = "GENERAL", "RELATED_TO"


def allocate_ids(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """new with ids after the largest stored one, in order."""
    return ids_after(new, stored.agg(F.max("id")).first()[0] or 0, order)


def ids_after(new: DataFrame, top: int, order: list[str]) -> DataFrame:
    """new with ids after top, in order."""
    nth = fresh(new, "nth")
    return row_numbers(new, [], order, nth).withColumn("id", F.col(nth) + F.lit(top)).drop(nth)


def new_codes(payload_codes: DataFrame, stored: DataFrame, default: str = DEFAULT_CLASSIFICATION, names: dict[str, str] = CLASSIFICATION_NAMES) -> DataFrame:
    """(code, display_name) of codes that aren't stored yet; payload_codes has a column `code`."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    codes = payload_codes.select(normalized_code(F.col("code"), default).alias("code")).distinct().join(stored.select("code"), "code", "left_anti")
    return codes.select("code", F.coalesce(known[F.col("code")], capitalized(F.col("code"))).alias("display_name"))


def document_key(uri: Column, title: Column, content: Column) -> Column:
    """What identifies a payload's document: its address if any, else title and content, else the title. The rule follows from the inputs alone."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(some(uri), F.concat(F.lit("u:"), uri)).when(some(title) & some(content), F.concat(F.lit("c:"), F.sha2(F.concat_ws("\x1f", title, content), 256))).otherwise(F.concat(F.lit("t:"), F.coalesce(title, F.lit(""))))


def stored_keys() -> Column:
    """All keys by which a stored document (title, normalized_content, source_uri) may be meant."""
    return F.array(F.concat(F.lit("u:"), "source_uri"), F.concat(F.lit("c:"), F.sha2(F.concat_ws("\x1f", "title", "normalized_content"), 256)), F.concat(F.lit("t:"), "title"))


def payload_title() -> Column:
    """A payload's title, or one that names its project."""
    return F.when(F.coalesce("document_title", F.lit("")) != "", F.col("document_title")).otherwise(F.concat(F.lit("External Document ("), F.col("source_project"), F.lit(")")))


def match_documents(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """(seq, document_id): the newest stored document of each payload, or null. Payloads have source_project, document_title, document_content, document_uri."""
    wanted = payloads.select("seq", document_key(F.col("document_uri"), payload_title(), F.col("document_content")).alias("key"))
    keys = F.explode(stored_keys())
    newest = stored.select("id", keys.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("document_id"))
    return wanted.join(newest, "key", "left").select("seq", "key", "document_id")


def over_limit(counts: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with more than `most` rows."""
    return counts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def claim_key(df: DataFrame) -> DataFrame:
    """df(document_id, quote, claim_text) with quote and statement trimmed; the statement defaults to the quote."""
    statement = F.when(F.coalesce("claim_text", F.lit("")) == "", F.col("quote")).otherwise(F.col("claim_text"))
    return df.withColumn("quote_text", strip(F.col("quote"))).withColumn("statement", strip(statement))


def match_claims(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per distinct incoming claim (document_id, quote_text, statement): the newest stored id or null, and the least (seq, pos)."""
    key = ["document_id", "quote_text", "statement"]
    distinct = claim_key(incoming).groupBy(*key).agg(F.min(F.struct("seq", "pos")).alias("at"), F.count("*").alias("n_incoming"))
    newest = stored.groupBy(*key).agg(F.max("id").alias("claim_id"))
    return distinct.join(newest, key, "left")


def newest_by_name(stored: DataFrame) -> DataFrame:
    """(name, id): of stored nodes with one name the newest stands for it."""
    return stored.groupBy("name").agg(F.max("id").alias("id"))


def resolve_entities(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(seq, pos, name, classification, node_id), a row per incoming row: by existing_node_id if stored, else the newest node of the exact stripped name, else null (a new entity)."""
    rows = incoming.withColumn("name", strip(F.col("name")))
    by_id = stored.select(F.col("id").alias("existing_node_id"), F.col("id").alias("id_hit")).distinct()
    by_name = newest_by_name(stored).withColumnRenamed("id", "name_hit")
    return rows.join(by_id, "existing_node_id", "left").join(by_name, "name", "left").select("seq", "pos", "name", "classification", F.coalesce("id_hit", "name_hit").alias("node_id"))


def new_entities(resolved: DataFrame) -> DataFrame:
    """Distinct names without a node, with the classification that came first."""
    return resolved.where("node_id IS NULL").groupBy("name").agg(F.min(F.struct("seq", "pos")).alias("at"), F.min_by("classification", F.struct("seq", "pos")).alias("classification"))


def last_descriptions(incoming: DataFrame) -> DataFrame:
    """(node_id, description): the last non-empty one."""
    return incoming.where(F.coalesce("description", F.lit("")) != "").groupBy("node_id").agg(F.max_by("description", F.struct("seq", "pos")).alias("description"))


#: Properties whose keys are merged one by one, the new value winning.
MERGED = ("reports", "metrics")


def merge_properties(patches: DataFrame) -> DataFrame:
    """(node_id, group, key, value) from patches(node_id, group, key, value, seq, pos), stored ones with the least seq.

    Within a group of MERGED the last value of a key wins, also the JSON text null, elsewhere the
    first. A value that is null itself says nothing of its key.
    """
    order = F.struct("seq", "pos")
    live = patches.where("value IS NOT NULL")
    return live.groupBy("node_id", "group", "key").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last")).select("node_id", "group", "key", F.when(F.col("group").isin(*MERGED), F.col("last")).otherwise(F.col("first")).alias("value"))


def attribute_claims(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(seq, node_id, claim_id): claims that an entity refers to, or that name it; all claims for a payload's only entity with none.

    entities(seq, node_id, name, claim_refs), claims(seq, ref_id, claim_id, quote_text, statement).
    Joined on the payload, so the substring test stays within it.
    """
    pairs = entities.join(claims, "seq")
    name = F.lower("name")
    hit = F.array_contains(F.coalesce("claim_refs", F.array().cast("array<string>")), F.col("ref_id")) | F.lower("quote_text").contains(name) | F.lower("statement").contains(name)
    found = pairs.where(hit).select("seq", "node_id", "claim_id")
    only = entities.groupBy("seq").agg(F.countDistinct("node_id").alias("n"), F.first("node_id").alias("node_id")).where("n = 1").join(found.select("seq").distinct(), "seq", "left_anti")
    return found.unionByName(only.join(claims, "seq").select("seq", "node_id", "claim_id")).distinct()


def union_evidence(stored: DataFrame, added: DataFrame) -> DataFrame:
    """(id, claim_ids, affected): the sorted union of a row's claims and added(id, claim_id); affected where it grew. Null counts as none; repeated pairs count once."""
    none = F.array().cast("array<bigint>")
    new_ids = fresh(stored, "new_ids")
    new = added.groupBy("id").agg(F.collect_set("claim_id").alias(new_ids))
    old = F.array_sort(F.array_distinct(F.coalesce("claim_ids", none)))
    merged = F.array_sort(F.array_union(F.coalesce("claim_ids", none), F.coalesce(new_ids, none)))
    return stored.join(new, "id", "left").select(*[c for c in stored.columns if c != "claim_ids"], merged.alias("claim_ids"), (merged != old).alias("affected"))


def resolve_endpoints(relations: DataFrame, entities: DataFrame, stored: DataFrame) -> DataFrame:
    """relations(seq, pos, source_ref, source_name, target_ref, target_name, relation) with source_id and target_id.

    An end is found by reference, else by name among the payload's entities in any case, else by
    exact name among stored nodes, the newest of these; else it stays null. A row per relation.
    """
    by_ref = entities.where("ref_id IS NOT NULL").groupBy("seq", F.col("ref_id").alias("ref")).agg(F.min_by("node_id", "pos").alias("ref_hit"))
    by_name = entities.groupBy("seq", F.lower(strip(F.col("name"))).alias("low")).agg(F.min_by("node_id", "pos").alias("name_hit"))
    exact = newest_by_name(stored).select(F.col("name").alias("exact"), F.col("id").alias("stored_hit"))
    helpers = {x: fresh(relations, x) for x in ("ref", "low", "exact", "ref_hit", "name_hit", "stored_hit")}
    by_ref, by_name, exact = (t.withColumnsRenamed({c: n for c, n in helpers.items() if c in t.columns}) for t in (by_ref, by_name, exact))
    ref, low, whole = helpers["ref"], helpers["low"], helpers["exact"]
    out = relations
    for end in ("source", "target"):
        keyed = out.withColumns({ref: F.col(f"{end}_ref"), low: F.lower(strip(F.col(f"{end}_name"))), whole: strip(F.col(f"{end}_name"))})
        joined = keyed.join(by_ref, ["seq", ref], "left").join(by_name, ["seq", low], "left").join(exact, whole, "left")
        out = joined.withColumn(f"{end}_id", F.coalesce(helpers["ref_hit"], helpers["name_hit"], helpers["stored_hit"])).drop(*helpers.values())
    return out


def rejected_payloads(resolved: DataFrame) -> DataFrame:
    """(seq, reason): payloads with a relation that lacks an end; such a payload is rejected as a whole."""
    lost = resolved.where("source_id IS NULL OR target_id IS NULL")
    text = F.concat_ws(" ", "relation", F.when(F.col("source_id").isNull(), F.concat(F.lit("source "), F.coalesce("source_ref", "source_name"))), F.when(F.col("target_id").isNull(), F.concat(F.lit("target "), F.coalesce("target_ref", "target_name"))))
    return lost.groupBy("seq").agg(F.min_by(text, "pos").alias("reason"))


def merge_edges(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per (source, target, relation): edge_id or null, sorted union of claim ids, the first claim of a new edge, and whether a stored edge changed.

    incoming(source, target, relation, claim_id, seq, pos), claim_id may be null;
    stored(id, source, target, relation, claim_ids).
    """
    key = ["source", "target", "relation"]
    none = F.array().cast("array<bigint>")
    new = incoming.withColumn("relation", normalized_code(F.col("relation"), DEFAULT_RELATION)).groupBy(*key).agg(F.array_sort(F.collect_set("claim_id")).alias("new_ids"), F.min_by("claim_id", F.when(F.col("claim_id").isNotNull(), F.struct("seq", "pos"))).alias("first_claim"))
    both = new.join(stored.withColumnRenamed("id", "edge_id"), key, "full")
    old = F.coalesce("claim_ids", none)
    merged = F.array_sort(F.array_union(old, F.coalesce("new_ids", none)))
    return both.select(*key, "edge_id", merged.alias("claim_ids"), F.when(F.col("edge_id").isNull(), F.col("first_claim")).alias("claim_id"), F.col("edge_id").isNull().alias("created"), (F.col("edge_id").isNotNull() & (merged != F.array_sort(old))).alias("affected"))


def orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orphan ids, nodes kept, edges kept): nodes without claims go, and the edges at them."""
    bare = F.size(F.coalesce("claim_ids", F.array().cast("array<bigint>"))) == 0
    gone = nodes.where(bare).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return gone, nodes.where(~bare), kept


def name_tokens(name: Column) -> Column:
    """Lower-case forms that stand for an entity: the name, what is in parentheses, and the name without these, of 2 characters or more."""
    low = F.lower(strip(name))
    inner = F.transform(F.regexp_extract_all(low, F.lit(r"\((.*?)\)"), 1), strip)
    outer = strip(F.regexp_replace(low, r"\(.*?\)", ""))
    return F.array_distinct(F.concat(F.array(low), F.filter(F.concat(inner, F.array(outer)), lambda x: F.length(x) >= 2)))


def reattribute(nodes: DataFrame, claims: DataFrame, scopes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, claim_ids): for each node the claims, of documents in scopes(id, document_id), that hold one of its tokens.

    aliases(name, alias) adds tokens. The scope is an equi-join; only its pairs are tested.
    """
    tokens = nodes.select("id", F.explode(name_tokens(F.col("name"))).alias("token"))
    if aliases is not None:
        tokens = tokens.unionByName(nodes.join(aliases, "name").select("id", F.lower("alias").alias("token"))).distinct()
    texts = claims.select("document_id", F.col("id").alias("claim_id"), F.lower(F.concat_ws(" ", "statement", "quote_text")).alias("text"))
    hit = tokens.join(scopes, "id").join(texts, "document_id").where(F.col("text").contains(F.col("token")))
    return hit.groupBy("id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def cascade_delete(deleted: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """child without rows whose key is among deleted(id)."""
    return child.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def set_null_on_delete(deleted: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """child with null keys where they are among deleted(id)."""
    mark = fresh(child, "gone")
    gone = deleted.select(F.col("id").alias(mark)).distinct()
    return child.join(gone, child[key] == gone[mark], "left").withColumn(key, F.when(F.col(mark).isNull(), F.col(key))).drop(mark)
