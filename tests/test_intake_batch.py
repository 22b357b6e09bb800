"""The write path at size: references are found in a payload's row, numbers take no second shuffle, and only what is read is worked out."""

from __future__ import annotations

from claimloom.operators import intake
from claimloom.operators.order import row_numbers


def node(ref, name, existing=None, refs=()):
    return (ref, name, "x", None, None, existing, None, list(refs))


def payload(seq, nodes, edges, claims):
    return (seq, "p", f"t{seq}", "some text", f"u{seq}", nodes, edges, claims)


BATCH = [
    payload(1, [node("a", " Ann "), node(None, "Bob"), node("a", "Cy")], [("a", None, None, "BOB", "knows", "k", ["k", "none"]), ("zz", None, "ann", "Far", "knows", None, None)], [("k", "Bob said so", None, None, None), ("k", "more", None, None, None)]),
    payload(0, [node("f", "Far")], None, [(None, "of nobody", None, None, None)]),
]


def test_references_are_places_in_the_row(spark):
    row = intake.prepared(spark.createDataFrame(BATCH, intake.PAYLOAD)).where("seq = 1").first()
    assert [n["claims"] for n in row["nodes"]] == [[], [0], []]
    first, second = row["edges"]
    assert (first["source_by_ref"], first["target_by_name"], second["source_by_ref"], second["source_by_name"]) == (0, 1, None, 0)
    assert second["target_by_ref"] is None and second["target_by_name"] is None
    assert [tuple(c) for c in first["cited"]] == [(0, 0), (0, 1)]


def test_only_what_is_read_is_worked_out(spark):
    out = intake.process(spark.createDataFrame(BATCH, intake.PAYLOAD), intake.empty_tables(spark))
    assert [r["code"] for r in out.tables["classifications"].collect()] == ["X"]
    assert not {"found", "with_claims", "evidence", "final"} & set(vars(out.of))
    names = {r["id"]: r["name"] for r in out.tables["nodes"].collect()}
    ties = {(names[r["source"]], names[r["target"]], len(r["claim_ids"])) for r in out.tables["edges"].collect()}
    assert ties == {("Ann", "Bob", 2), ("Ann", "Far", 0)}
    held = {r["name"]: len(r["claim_ids"]) for r in out.tables["nodes"].collect()}
    assert held == {"Ann": 2, "Bob": 2, "Cy": 0, "Far": 1}


def test_numbers_over_all_rows_are_read_without_a_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "1000 - id AS o").repartition(5)
    got = row_numbers(df, [], ["o"], "n")
    assert "hashpartitioning(span" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["n"] for r in got.collect()} == {i: 1000 - i for i in range(1000)}


def test_reviewed_entities_are_joined_by_measured_sizes(spark):
    from claimloom.plans import flows

    got = flows.e16_notices_to_graph(spark, "/root/testdata/sf0.001")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # joined in materialize, not by sizes of files
    assert got.where("classification = 'PROGRAM'").count() > 0
