"""Entities and relations of producers' bundles, approved by reviewers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from claimloom.operators import adapters, order, producers
from claimloom.plans import flows
from claimloom.plans.scratch import materialize

ACTOR = "struct<name: string, classification: string, existing_node_id: bigint, points: array<int>, report_point: int, report: string>"
TIE = "struct<source: string, target: string, relation: string, point: int>"
SENTENCES = "sentences array<struct<index: bigint, text: string>>, keyPoints array<struct<text: string, evidence: array<bigint>>>"


def articles(spark):
    told = [(0, "s0"), (1, "s1")], [("p0", [0]), ("p1", [1])]
    actors = [("A ", "COMPANY", 7, [0, 0, 9], None, None), ("B", "COMPANY", None, [1, 0], 1, '{"x": 1}'), (" ", "COMPANY", None, [0], None, None), (None, "COMPANY", None, [0], None, None), ("C", None, None, None, 0, "{")]
    ties = [("A", "B", "SUPPLIES", 0), ("A", None, "SUPPLIES", 0), ("A", "B", "OWNS", 5), ("B", "nobody", "OWNS", 0)]
    rows = [(1, 1, "t", "body", None, *told, actors, ties, "extra"), (2, 3, "u", "body", None, *told, actors, ties, "extra"), (4, 4, "v", "body", None, *told, None, None, "extra")]
    return spark.createDataFrame(rows, f"id bigint, analysisArticleId bigint, title string, bodyText string, url string, {SENTENCES}, actors array<{ACTOR}>, ties array<{TIE}>, pos string")


def payloads(documents, claims, parts, enabled):
    items = claims.select(F.col("item_id").alias("id"), F.col("ref").isin(*enabled).alias("enabled"), F.lit(False).alias("blocked"))
    found = adapters.approved_payloads(documents, claims, *parts, items, items.select("id", F.col("id").alias("parent")).where("false"))
    return [r.asDict(recursive=True) for r in found.orderBy("seq").collect()]


def test_actors_hang_on_approved_points_and_carry_stored_entities(spark):
    items = articles(spark)
    documents, claims, rejected = adapters.news_bundle(items)
    assert [r.error for r in rejected.collect()] == ["ANALYSIS_SOURCE_MISMATCH"]
    parts = producers.news_graph(items, claims)
    both, one = payloads(documents, claims, parts, ["n-c1", "n-c2"]), payloads(documents, claims, parts, ["n-c2"])
    shown = lambda p: [(n["name"], n["existing_node_id"], n["claim_refs"], n["properties"]) for n in p["nodes"] or []]
    assert shown(both[0]) == [("A", 7, ["c0"], None), ("B", None, ["c0", "c1"], '{"reports":{"news":{"x":1}}}')]
    assert [(e["source_name"], e["target_name"], e["relation"], e["claim_refs"]) for e in both[0]["edges"]] == [("A", "B", "SUPPLIES", ["c0"])]
    assert shown(one[0]) == [("B", None, ["c0"], '{"reports":{"news":{"x":1}}}')] and not one[0]["edges"]
    assert [p["document_title"] for p in both] == ["t", "v"] and not both[1]["nodes"]


def test_a_workbook_s_entity_is_there_without_approval(spark):
    claims = spark.createDataFrame([(1, "excel-snapshot", 0, "i0", "e-c1", "q", "s", "FACT", 12.0, 12.0), (1, "excel-snapshot", 1, "i1", "e-c2", "q", "s", "DERIVED_FACT", 20.0, 12.0)], "bundle long, document string, pos int, item_id string, ref string, quote string, statement string, modality string, value double, fact double")
    documents = spark.createDataFrame([(1, "excel-snapshot", "excel", "t", "c", None, True)], "bundle long, document string, source_project string, title string, content string, uri string, always boolean")
    subjects = spark.createDataFrame([(1, "W", "COMPANY", 3), (9, "no book", "COMPANY", None)], "bundle long, name string, classification string, existing_node_id long")
    parts = producers.workbook_graph(claims, subjects, "revenue")
    node = lambda enabled: payloads(documents, claims, parts, enabled)[0]["nodes"][0]
    bare, whole = node([]), node(["e-c1", "e-c2"])
    assert (bare["name"], bare["existing_node_id"], bare["claim_refs"], bare["properties"]) == ("W", 3, [], None)
    assert whole["claim_refs"] == ["c0", "c1"]
    assert json.loads(whole["properties"]) == {"metrics": {"revenue": {"value": 12.0}}, "reports": {"excel": {"facts": {"revenue": {"value": 12.0}}, "growth": {"revenue": {"value": 20.0}}}}}
    assert json.loads(node(["e-c2"])["properties"]) == {"reports": {"excel": {"facts": {"revenue": {"value": 12.0}}, "growth": {"revenue": {"value": 20.0}}}}}
    assert parts[1].count() == 0 and producers.workbook_graph(claims.where("false"), subjects, "r")[0].count() == 0


def test_recommendations_tie_nothing_and_rejected_findings_name_nobody(spark):
    schema = "id long, preparation string, organiser struct<name: string, existing_node_id: long>, program struct<name: string, existing_node_id: long, properties: string>, subjects array<struct<name: string, existing_node_id: long>>"
    notices = spark.createDataFrame([(1, '{"a": 1}', ("O", None), ("P", 5, '{"b": 2}'), [("S", 8), (None, 9)]), (2, "no json", (None, None), ("P", None, None), None)], schema)
    kinds = [("gov-body", 0, "graph"), ("gov-report", 1, "external_analysis_only"), ("gov-body", 2, "node_panel_only"), ("gov-body", 3, "rejected")]
    claims = spark.createDataFrame([(b, d, p, f"{b}:{p}", f"g-c{p + 1}", to) for b in (1, 2) for d, p, to in kinds], "bundle long, document string, pos int, item_id string, ref string, destination string")
    entities, relations = producers.gov_graph(notices, claims)
    got = sorted((r.bundle, r.document, r.item_id, r.name, r.existing_node_id, r.properties) for r in entities.collect())
    assert got == [(1, "gov-body", "1:0", "O", None, None), (1, "gov-body", "1:0", "P", 5, '{"b": 2}'), (1, "gov-body", "1:2", "P", 5, '{"b": 2}'), (1, "gov-report", "1:1", "S", 8, '{"reports":{"gov":{"a":1}}}'), (2, "gov-body", "2:0", "P", None, None), (2, "gov-body", "2:2", "P", None, None)]
    assert [(r.bundle, r.source, r.target, r.relation) for r in relations.collect()] == [(1, "O", "P", "ORGANIZES")]


def test_parts_of_a_payload_are_numbered_without_ranges(spark, monkeypatch):
    """Only payloads are numbered over all rows; their claims and entities end in one row each."""
    made = []
    monkeypatch.setattr(order, "materialize", lambda df, label: made.append(label) or materialize(df, label))
    assert flows.e12_approved_payloads(spark, "/root/testdata/sf0.001").count() > 0
    assert made == ["ranges"]
