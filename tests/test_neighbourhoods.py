"""Neighbourhoods of many centres against single ones and against a literal walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import graph, neighbourhoods


def walk(ids, edges, center, hops, limit, fill):
    """(id, hop) pairs, edges and what was left out, in Python."""
    if center not in ids:
        return [], [], None
    seen, frontier, left_out = {center: 0}, {center}, 0
    for hop in range(1, hops + 1):
        new = {}
        for e, s, t in edges:
            for a, b in ((s, t), (t, s)):
                if a in frontier and b not in seen:
                    new[b] = min(new.get(b, e), e)
        order = sorted(new, key=lambda n: (new[n], n))
        if limit is not None:
            left_out += max(0, len(order) - limit)
            order = order[:limit]
        seen |= {n: hop for n in order}
        frontier = set(order)
    if fill:
        room = min(15, (limit or 60) - len(seen))
        seen |= {n: 4 for n in sorted(ids - set(seen), reverse=True)[: max(room, 0)]}
    tier = lambda r: {0: "SELF", 1: "DIRECT", 2: "TWO_HOP", 3: "THREE_HOP"}.get(r, "AMBIENT")
    return sorted((n, h) for n, h in seen.items()), sorted((e, tier(max(min(seen[s], 4), min(seen[t], 4), 1))) for e, s, t in edges if s in seen and t in seen), left_out


@pytest.fixture(scope="module")
def tables(spark):
    """A hub with a third of all edge ends, parallel edges, self-loops, and nodes without edges."""
    r = random.Random(4)
    ids = set(range(1, 121))
    pairs = [(7, r.randint(1, 100)) for _ in range(60)] + [(r.randint(1, 100), r.randint(1, 100)) for _ in range(90)] + [(3, 3), (5, 6), (5, 6)]
    edges = [(k + 1, s, t) for k, (s, t) in enumerate(pairs)]
    nodes = spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    return ids, edges, nodes, spark.createDataFrame([(*e, "R") for e in edges], "id long, source long, target long, relation string")


@pytest.mark.parametrize("hops, limit, fill", [(2, 5, True), (4, None, False), (3, 100, True)])
def test_all_centres_at_once(spark, tables, hops, limit, fill):
    ids, edges, nodes, table = tables
    asked = [*range(1, 105), 110, 999, 7, None]
    centers = spark.createDataFrame([(c,) for c in asked], "center long")
    at = neighbourhoods.layout(table, hub_edges=8)
    assert {r["node"] for r in at.hubs.collect()} >= {7} and at.ends.where("node = 7").select("part").distinct().count() > 1
    got = neighbourhoods.subgraphs(nodes, table, centers, hops, limit, fill, at)
    found, links, left = {}, {}, dict(map(tuple, got.omitted.collect()))
    for r in got.nodes.collect():
        found.setdefault(r["center"], []).append((r["id"], r["hop"]))
    for r in got.edges.collect():
        links.setdefault(r["center"], []).append((r["id"], r["tier"]))
    assert set(found) == set(left) == {c for c in asked if c in ids}
    for c in found:
        nodes_, edges_, out = walk(ids, edges, c, hops, limit, fill)
        assert (sorted(found[c]), sorted(links.get(c, [])), left[c]) == (nodes_, edges_, out), c


def test_one_centre_is_the_same_as_alone(spark, tables):
    _, _, nodes, table = tables
    alone = graph.subgraph(nodes, table, 7, 2, 5)
    many = neighbourhoods.subgraphs(nodes, table, spark.createDataFrame([(7,), (8,)], "center long"), 2, 5)
    assert sorted(map(tuple, alone.nodes.collect())) == sorted(map(tuple, many.nodes.where("center = 7").select("id", "hop", "tier").collect()))
    assert sorted(map(tuple, alone.edges.select("id", "tier").collect())) == sorted(map(tuple, many.edges.where("center = 7").select("id", "tier").collect()))
    assert many.omitted.where("center = 7").first()["omitted"] == alone.omitted
    assert neighbourhoods.subgraphs(nodes, table.where("false"), spark.createDataFrame([(7,)], "center long"), 2, 5, fill=False).nodes.count() == 1
    assert neighbourhoods.subgraphs(nodes, table, spark.createDataFrame([], "center long")).nodes.count() == 0


def test_centres_at_a_hub_do_not_list_all_of_it(spark, monkeypatch):
    """Three hundred centres around one hub: a hop writes the limit and what was visited for each, and the result is that of each centre alone."""
    nodes = spark.range(301).select("id")
    edges = spark.range(1, 301).select("id", F.col("id").alias("source"), F.lit(0).cast("bigint").alias("target"))
    written = []
    real = neighbourhoods.materialize
    monkeypatch.setattr(neighbourhoods, "materialize", lambda df, label: written.append((label, real(df, label))) or written[-1][1])
    at = neighbourhoods.layout(edges)
    visited, omitted = neighbourhoods.reach(nodes, at, nodes.select(F.col("id").alias("center")), 2, 3)
    assert max(df.count() for label, df in written if label == "hop-all") <= 301 * 7
    for center in (0, 2, 300):
        alone, left_out = graph.reach(nodes, edges, center, 2, 3)
        assert {tuple(r) for r in visited.where(F.col("center") == center).select("id", "hop").collect()} == {tuple(r) for r in alone.collect()}
        assert omitted.where(F.col("center") == center).first()["omitted"] == left_out
