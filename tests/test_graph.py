from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimloom.operators import graph


@pytest.fixture(scope="module")
def tiny(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", "X", None) for i in range(1, 9)], "id long, name string, classification string, description string")
    edges = [(1, 1, 2, "R"), (2, 2, 1, "R"), (3, 1, 2, "S"), (4, 2, 3, "R"), (5, 3, 4, "R"), (6, 4, 5, "R"), (7, 1, 1, "R"), (8, 6, 7, "R")]
    return nodes, spark.createDataFrame(edges, "id long, source long, target long, relation string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_reach_by_first_hop_through_cycles_parallel_edges_and_self_loops(tiny):
    found = graph.subgraph(*tiny, 1, 4, None, fill=False)
    assert rows(found.nodes, "id", "tier") == [(1, "SELF"), (2, "DIRECT"), (3, "TWO_HOP"), (4, "THREE_HOP"), (5, "AMBIENT")]
    assert rows(found.edges, "id", "tier") == [(1, "DIRECT"), (2, "DIRECT"), (3, "DIRECT"), (4, "TWO_HOP"), (5, "THREE_HOP"), (6, "AMBIENT"), (7, "DIRECT")]


def test_limits_missing_centre_and_no_hops(tiny):
    assert graph.reach(*tiny, 99, 2)[0].count() == 0
    assert rows(graph.reach(*tiny, 1, 0)[0], "id") == [(1,)]
    seen, omitted = graph.reach(*tiny, 1, 1, 0)
    assert (rows(seen, "id"), omitted) == ([(1,)], 1)


def test_ambient_fill_takes_the_newest_other_nodes(tiny):
    nodes, edges = tiny
    seen, _ = graph.reach(nodes, edges, 1, 1)
    assert rows(graph.ambient_fill(nodes, seen, 4), "id") == [(7,), (8,)]
    assert rows(graph.ambient_fill(nodes, seen, 0), "id") == [(i,) for i in range(3, 9)]
    assert graph.ambient_fill(nodes, seen, 2).count() == 0


def test_degree_counts_self_loops_twice_and_falls_back_to_the_newest(spark, tiny):
    nodes, edges = tiny
    assert graph.top_degree(nodes, edges).first()[:3] == (1, "n1", 5)
    assert graph.top_degree(nodes, edges.where("false")).first()[:3] == (8, "n8", 0)


def test_search_wildcards_and_escape(spark):
    nodes = spark.createDataFrame([(1, "a_b", None), (2, "axb", None), (3, "z", "has A_B")], "id long, name string, description string")
    assert rows(graph.search(nodes, "a_b"), "id") == [(1,), (2,), (3,)]
    assert rows(graph.search(nodes, "a_b", escape=True), "id") == [(1,), (3,)]
    assert rows(graph.search(nodes, ""), "id") == [(1,), (2,), (3,)]


def test_cursor_round_trip_and_rejection():
    c = graph.encode_cursor("k", "s", [3, "x"])
    assert graph.decode_cursor(c, "k", "s", (int, str)) == [3, "x"]
    for kind, scope, shape in (("j", "s", (int, str)), ("k", "t", (int, str)), ("k", "s", (str, str)), ("k", "s", (int,))):
        with pytest.raises(ValueError):
            graph.decode_cursor(c, kind, scope, shape)
    with pytest.raises(ValueError):
        graph.decode_cursor("%%%", "k", "s", ())


def test_fingerprints_find_stale_work(spark, tiny):
    nodes, edges = tiny
    nodes = nodes.withColumn("claim_ids", graph.F.array(graph.F.lit(2).cast("bigint"), graph.F.lit(1).cast("bigint")))
    inputs = graph.insight_inputs(nodes, edges)
    done = inputs.select(graph.F.col("id").alias("node_id"), graph.F.col("fingerprint").alias("input_fingerprint"))
    assert graph.stale(inputs, done).count() == 0
    assert rows(graph.stale(graph.insight_inputs(nodes, edges.where("id <> 6")), done), "id") == [(4,), (5,)]
    assert graph.accept_fresh(done, graph.insight_inputs(nodes, edges.where("id <> 6"))).count() == 6


def test_all_pages_at_once_are_those_of_cursors(spark):
    """Number of jobs and rows in the driver don't follow the pages: the result is the operator's own, over any number of rows."""
    df = spark.range(95).select((F.col("id") % 3).cast("string").alias("code"), F.col("id"))
    paged, values = {}, None
    while True:
        rows = graph.page_after(df, ["code", "id"], values, 10).collect()
        number = max(paged.values(), default=-1) + 1
        paged |= {r["id"]: number for r in rows}
        if len(rows) < 10:
            break
        values = graph.decode_cursor(graph.encode_cursor("all", "x", list(rows[-1])), "all", "x", (str, int))
    assert {r["id"]: r["page"] for r in graph.pages(df, ["code", "id"], 10).collect()} == paged


def test_first_edges_are_cut_before_repeats_go(spark):
    """A self-loop and a repeated row count once, and what is gathered are the first edges only."""
    edges = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 1, 2), (3, 2, 1), (4, 1, 3)], "id long, source long, target long")
    found = graph.incident_edges(edges, 2)
    assert rows(found, "node", "edge", "rank") == [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 3, 2), (3, 4, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Window")


def test_first_edges_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks follow the number of ends, and a node with more than a task sorts is cut in parts; the first edges are those of a plain sort."""
    monkeypatch.setattr(graph, "ENDS_OF_TASK", 100)
    made = [(e, 7 if e % 3 else e % 11, e % 50) for e in range(1200)]
    edges = spark.createDataFrame([*made, (7, 7, 7)], "id long, source long, target long")
    found = graph.incident_edges(edges, 5)
    ends = sorted({(n, e) for e, s, t in [*made, (7, 7, 7)] for n in (s, t)})
    first = {n: [e for m, e in ends if m == n][:5] for n, _ in ends}
    assert rows(found, "node", "edge", "rank") == sorted((n, e, k + 1) for n, es in first.items() for k, e in enumerate(es))
    assert found.rdd.getNumPartitions() >= 2402 // 100
    some = spark.createDataFrame([(7,), (3,), (99,), (None,)], "id long")
    assert rows(graph.incident_edges(edges, 5, some), "node", "edge") == sorted((n, e) for n in (3, 7) for e in first[n])
