from __future__ import annotations

import json

import pytest

from claimloom.operators import intake
from claimloom.plans.scratch import materialize


def payload(seq, nodes=(), edges=(), claims=(), uri="u", title="T", content="body"):
    node = lambda n: (n.get("ref"), n["name"], n.get("cls"), n.get("desc"), json.dumps(n["props"]) if "props" in n else None, n.get("id"), None, n.get("claims"))
    edge = lambda e: (e.get("sr"), e.get("tr"), e.get("s"), e.get("t"), e.get("rel"), e.get("claim"), e.get("claims"))
    claim = lambda i, c: (f"c{i}", c, None, None, None)
    return (seq, "p", title, content, uri, [node(n) for n in nodes], [edge(e) for e in edges], [claim(i, c) for i, c in enumerate(claims)])


def fold(spark, tables, *payloads, **limits):
    out = intake.process(spark.createDataFrame(list(payloads), intake.PAYLOAD), tables, **limits)
    return {k: materialize(v, "test") for k, v in out.tables.items()}, {r["seq"]: r for r in out.results.collect()}, sorted(r[0] for r in out.affected.collect())


def count(tables):
    return {k: tables[k].count() for k in ("documents", "claims", "nodes", "edges")}


def named(tables):
    return {r["name"]: r for r in tables["nodes"].collect()}


FIRST = payload(1, [{"ref": "n0", "name": "Acme", "cls": "company", "props": {"employees": 500, "metrics": {"a": 1}}}, {"ref": "n1", "name": "Plant"}], [{"sr": "n0", "tr": "n1", "rel": "operates", "claim": "c0"}], ["Acme runs it", "unrelated"], content="x Acme runs it")


@pytest.fixture(scope="module")
def after_first(spark):
    return fold(spark, intake.empty_tables(spark), FIRST)


def test_first_load_and_replay(spark, after_first):
    tables, results, affected = after_first
    assert count(tables) == {"documents": 1, "claims": 2, "nodes": 2, "edges": 1}
    assert results[1]["accepted"] and results[1]["primary_node_id"] == named(tables)["Acme"]["id"] and affected == [1, 2]
    assert [tuple(r)[4:] for r in tables["claims"].orderBy("id").collect()] == [(2, 14), (None, None)]
    assert {r["code"]: r["display_name"] for r in tables["classifications"].collect()} == {"COMPANY": "기업", "GENERAL": "일반"}
    assert named(tables)["Plant"]["claim_ids"] == [1]
    again, results, affected = fold(spark, tables, FIRST)
    assert (count(again), affected) == (count(tables), [])
    assert sorted(map(str, again["nodes"].collect())) == sorted(map(str, tables["nodes"].collect()))


def test_properties_and_evidence_accumulate_across_sources(spark, after_first):
    tables, *_ = after_first
    second = payload(2, [{"name": " Acme ", "cls": "topic", "desc": "maker", "props": {"employees": 9999, "target": "x", "metrics": {"a": 2, "b": 3}}}], [], ["Acme plans more"], uri="v")
    got, _, affected = fold(spark, tables, second)
    acme = named(got)["Acme"]
    assert json.loads(acme["properties"]) == {"employees": 500, "target": "x", "metrics": {"a": 2, "b": 3}}
    assert (acme["classification"], acme["description"], acme["claim_ids"], affected) == ("COMPANY", "maker", [1, 3], [1])
    assert got["documents"].count() == 2


def test_unresolved_ends_reject_whole_payloads_and_what_hangs_on_them(spark, after_first):
    tables, *_ = after_first
    bad = payload(3, [{"name": "Ghost"}], [{"s": "Ghost", "t": "Nowhere", "rel": "uses"}], ["Ghost claim"])
    hangs = payload(4, [{"name": "Late"}], [{"s": "Late", "t": "Ghost"}])
    fine = payload(5, [{"name": "Five"}], [{"s": "five", "t": "Plant"}])
    later = payload(6, [{"name": "Six"}], [{"s": "Six", "t": "Five"}])
    got, results, _ = fold(spark, tables, bad, hangs, fine, later)
    assert {k: r["accepted"] for k, r in results.items()} == {3: False, 4: False, 5: True, 6: True}
    assert "USES" in results[3]["reason"] and "Nowhere" in results[3]["reason"]
    assert set(named(got)) == {"Acme", "Plant", "Five", "Six"} and got["edges"].count() == 3


def test_claim_limit_counts_over_the_batch(spark):
    a = payload(1, [{"name": "A"}], [], [f"q{i}" for i in range(99)])
    b = payload(2, [], [], ["x", "y"])
    c = payload(3, [], [], ["q5", "z"])
    got, results, _ = fold(spark, intake.empty_tables(spark), a, b, c, most_claims=100)
    assert {k: r["accepted"] for k, r in results.items()} == {1: True, 2: False, 3: True}
    assert got["claims"].count() == 100 and len(named(got)["A"]["claim_ids"]) == 99


def test_without_limits_nothing_is_rejected_and_long_lists_keep_their_order(spark):
    many = [payload(k, uri=f"u{k}") for k in range(2, 1502)]
    refs = [f"c{i}" for i in range(1199, -1, -1)]
    long = payload(1, [{"ref": "a", "name": "A"}, {"ref": "b", "name": "B"}], [{"sr": "a", "tr": "b", "rel": "x", "claims": refs}, {"sr": "b", "tr": "a", "rel": "y", "claims": ["c7"]}], [f"q{i}" for i in range(1200)], uri="long")
    got, results, _ = fold(spark, intake.empty_tables(spark), long, *many)
    assert all(r["accepted"] for r in results.values()) and got["documents"].count() == 1501 and got["claims"].count() == 1200
    edges = {r["relation"]: r for r in got["edges"].collect()}
    ids = {r["quote_text"]: r["id"] for r in got["claims"].collect()}
    assert (edges["X"]["claim_id"], edges["Y"]["claim_id"]) == (ids["q1199"], ids["q7"])
    _, results, _ = fold(spark, intake.empty_tables(spark), long, *many, most_documents=1000, most_claims=1000)
    assert not results[1]["accepted"] and "claims" in results[1]["reason"]
    assert sum(r["accepted"] for r in results.values()) == 1000 and "1000 documents" in results[1501]["reason"]


def test_changes_and_counters(spark, after_first):
    tables, *_ = after_first
    more = payload(9, [{"ref": "n0", "name": "Acme"}, {"ref": "n2", "name": "New"}], [{"sr": "n0", "tr": "n2", "rel": "uses", "claim": "c1"}], ["Acme runs it", "New one"], uri="u")
    out = intake.process(spark.createDataFrame([more], intake.PAYLOAD), tables)
    assert tuple(out.counters.first()) == (0, 1, 1, 1, 1)
    changes = {k: v.count() for k, v in out.changes.items()}
    assert changes == {"documents": 0, "claims": 1, "nodes": 2, "edges": 1, "classifications": 0, "relations": 1}
    again = intake.process(spark.createDataFrame([more], intake.PAYLOAD), {k: materialize(v, "test") for k, v in out.tables.items()})
    assert tuple(again.counters.first()) == (0, 0, 2, 0, 0) and not any(v.count() for v in again.changes.values())
