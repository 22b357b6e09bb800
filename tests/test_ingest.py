from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_document_identity_follows_the_inputs(spark):
    stored = spark.createDataFrame([(1, "T", "c", "u1"), (2, "T", "c", None), (3, "T", "d", None), (4, "T", "c", None)], "id long, title string, normalized_content string, source_uri string")
    payloads = spark.createDataFrame(
        [(1, "p", "X", "y", "u1"), (2, "p", "T", "c", None), (3, "p", "T", None, None), (4, "p", "T", "c", "u9"), (5, "p", None, None, None)],
        "seq int, source_project string, document_title string, document_content string, document_uri string",
    )
    assert rows(ingest.match_documents(payloads, stored), "seq", "document_id") == [(1, 1), (2, 4), (3, 4), (4, None), (5, None)]


def test_replayed_claims_and_edges_create_nothing(spark):
    incoming = spark.createDataFrame([(1, " q ", None, 1, 0), (1, "q", "q", 1, 1), (1, "r", "s", 2, 0)], "document_id long, quote string, claim_text string, seq int, pos int")
    empty = spark.createDataFrame([], "id long, document_id long, quote_text string, statement string")
    first = ingest.match_claims(incoming, empty)
    assert rows(first, "quote_text", "statement", "claim_id") == [("q", "q", None), ("r", "s", None)]
    stored = ingest.allocate_ids(first.select("document_id", "quote_text", "statement", "at"), empty, ["at"])
    assert rows(stored, "id", "quote_text") == [(1, "q"), (2, "r")]
    assert ingest.match_claims(incoming, stored).where("claim_id IS NULL").count() == 0

    edges = spark.createDataFrame([(1, 2, "uses", 5, 1, 0), (1, 2, " USES", 4, 1, 1), (1, 3, None, None, 1, 2)], "source long, target long, relation string, claim_id long, seq int, pos int")
    none = spark.createDataFrame([], "id long, source long, target long, relation string, claim_ids array<bigint>")
    made = ingest.merge_edges(edges, none)
    assert rows(made, "relation", "claim_ids", "claim_id", "created") == [("RELATED_TO", [], None, True), ("USES", [4, 5], 5, True)]
    again = ingest.merge_edges(edges, made.withColumn("id", F.lit(1)).select("id", "source", "target", "relation", "claim_ids"))
    assert rows(again, "created", "affected") == [(False, False), (False, False)]


def test_entities_resolve_by_id_then_trimmed_name(spark):
    stored = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    incoming = spark.createDataFrame([(1, 0, "A ", "X", None), (1, 1, "z", "X", 2), (1, 2, "A", "X", 99), (2, 0, "new", "Y", None), (3, 0, " new", "Z", None), (3, 1, "a", "Z", None)], "seq int, pos int, name string, classification string, existing_node_id long")
    found = ingest.resolve_entities(incoming, stored)
    assert rows(found, "seq", "pos", "node_id") == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, None), (3, 0, None), (3, 1, None)]
    assert rows(ingest.new_entities(found), "name", "classification") == [("a", "Z"), ("new", "Y")]


def test_white_space_of_any_kind_and_repeated_names(spark):
    claims = spark.createDataFrame([(1, "q", None, 1, 0), (1, "q\n", None, 1, 1), (1, "\u00a0q\t", "\u3000", 1, 2)], "document_id long, quote string, claim_text string, seq int, pos int")
    none = spark.createDataFrame([], "id long, document_id long, quote_text string, statement string")
    assert rows(ingest.match_claims(claims, none), "quote_text", "statement") == [("q", ""), ("q", "q")]
    stored = spark.createDataFrame([(1, "Acme"), (5, "Acme"), (3, "Acme")], "id long, name string")
    incoming = spark.createDataFrame([(1, 0, "Acme\t", "X", None)], "seq int, pos int, name string, classification string, existing_node_id long")
    assert rows(ingest.resolve_entities(incoming, stored), "name", "node_id") == [("Acme", 5)]
    relation = spark.createDataFrame([(1, 0, None, "Acme\n", None, "Acme", "R", "kept", "k2")], "seq int, pos int, source_ref string, source_name string, target_ref string, target_name string, relation string, low string, exact string")
    entities = spark.createDataFrame([], "seq int, pos int, ref_id string, name string, node_id long")
    assert rows(ingest.resolve_endpoints(relation, entities, stored), "source_id", "target_id", "low", "exact") == [(5, 5, "kept", "k2")]
    assert ingest.resolve_endpoints(relation.where("false"), entities, stored).count() == 0


def test_properties_first_writer_wins_but_for_merged_groups(spark):
    patches = spark.createDataFrame([(1, "", "employees", "500", 0, 0), (1, "", "employees", "9999", 1, 0), (1, "", "target", "7", 1, 1), (1, "metrics", "rev", "1", 0, 0), (1, "metrics", "rev", "2", 1, 0), (1, "", "x", None, 0, 0)], "node_id int, group string, key string, value string, seq int, pos int")
    assert rows(ingest.merge_properties(patches), "key", "value") == [("employees", "500"), ("rev", "2"), ("target", "7")]


def test_claims_attribute_by_reference_name_and_fallback(spark):
    entities = spark.createDataFrame([(1, 10, "Acme", None), (1, 11, "Zed", ["c1"]), (2, 12, "Lone", None)], "seq int, node_id int, name string, claim_refs array<string>")
    claims = spark.createDataFrame([(1, "c0", 100, "ACME grows", ""), (1, "c1", 101, "other", ""), (2, "c0", 102, "nothing", "")], "seq int, ref_id string, claim_id int, quote_text string, statement string")
    assert rows(ingest.attribute_claims(entities, claims), "node_id", "claim_id") == [(10, 100), (11, 101), (12, 102)]


def test_endpoints_prefer_references_and_reject_whole_payloads(spark):
    relations = spark.createDataFrame([(1, 0, "n0", "wrong", None, "b", "R"), (1, 1, None, "a", None, "Stored", "R"), (2, 0, "n0", None, None, "Nowhere", "R")], "seq int, pos int, source_ref string, source_name string, target_ref string, target_name string, relation string")
    entities = spark.createDataFrame([(1, 0, "n0", "A", 1), (1, 1, "n1", "B", 2), (2, 0, "n9", "C", 3)], "seq int, pos int, ref_id string, name string, node_id int")
    stored = spark.createDataFrame([(7, "Stored")], "id int, name string")
    found = ingest.resolve_endpoints(relations, entities, stored)
    assert rows(found, "seq", "pos", "source_id", "target_id") == [(1, 0, 1, 2), (1, 1, 1, 7), (2, 0, None, None)]
    assert rows(ingest.rejected_payloads(found), "seq", "reason") == [(2, "R source n0 target Nowhere")]


def test_evidence_union_orphans_and_deletes(spark):
    stored = spark.createDataFrame([(1, [2, 1]), (2, None), (3, [5])], "id int, claim_ids array<bigint>")
    added = spark.createDataFrame([(1, 1), (3, 6)], "id int, claim_id long")
    assert rows(ingest.union_evidence(stored, added), "id", "claim_ids", "affected") == [(1, [1, 2], False), (2, [], False), (3, [5, 6], True)]
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "id int, source int, target int")
    gone, kept, left = ingest.orphans(stored, edges)
    assert (rows(gone, "id"), rows(kept, "id"), rows(left, "id")) == ([(2,)], [(1,), (3,)], [(2,)])
    assert rows(ingest.cascade_delete(gone, edges, "target"), "id") == [(2,)]
    assert rows(ingest.set_null_on_delete(gone, edges, "target"), "id", "target") == [(1, None), (2, 3)]


def test_name_tokens(spark):
    df = spark.createDataFrame([("Alpha Beta (AB) (x)",)], "name string")
    assert df.select(ingest.name_tokens(F.col("name"))).first()[0] == ["alpha beta (ab) (x)", "ab", "alpha beta"]
