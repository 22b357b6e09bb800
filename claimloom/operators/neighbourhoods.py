"""Neighbourhoods of many centres at once: what `graph.subgraph` gives for one, as one job for all of a table of centres.

The frontier is a table of (centre, node). Edges are laid out once by node, in both directions; the
edges of a hub (a node with more than HUB_EDGES) are dealt into parts, and a frontier's row at a hub is
repeated for these, so that no task joins all of them. A hop reduces (centre, other) to the least edge
before it is shuffled, and a limit keeps each centre's first nodes by bounded top-k, in parts first.

With a limit, a hop reads only the head of each node's edges: of a node's neighbours by least edge,
those behind the first limit + visited ones have as many unvisited ones before them as the limit
lets through. So centres that share a hub don't list all of it each; only `omitted`, which counts
what is left out and isn't computed before it is read, does.

Defined results: centres that aren't nodes, and null centres, give no rows; repeated centres count
once. Ties, limits, tiers and filling are those of `graph.reach`, `graph.ambient_fill` and
`graph.induced_edges`, for each centre by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import graph
from claimloom.plans.scratch import materialize

#: Edge ends of a node from which it is a hub, and as many as a part of a hub has.
HUB_EDGES = 50_000
#: Hubs, and rows of a frontier or of members, that are broadcast; more are joined by shuffle.
HUBS_SENT, ROWS_SENT = 100_000, 1_000_000


@dataclass
class Layout:
    """ends(node, part, other, edge): each edge from either end; hubs(node, parts): into how many parts hubs are dealt."""

    ends: DataFrame
    hubs: DataFrame
    few_hubs: bool


def layout(edges: DataFrame, hub_edges: int = HUB_EDGES) -> Layout:
    """Lay edges(id, source, target) out for hops. Made once for any number of neighbourhoods."""
    ends = graph.undirected(edges)
    sizes = ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hub_edges)
    hubs = materialize(sizes.select("node", F.ceil(F.col("n") / hub_edges).cast("int").alias("parts")), "hubs")
    few = hubs.count() <= HUBS_SENT
    dealt = ends.join(F.broadcast(hubs) if few else hubs, "node", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("edge", "other"), F.coalesce("parts", F.lit(1))).cast("int"))
    return Layout(materialize(dealt.select("node", part.alias("part"), "other", "edge"), "edge-layout"), hubs, few)


def _around(frontier: DataFrame, at: Layout, few: bool) -> DataFrame:
    """(center, other, edge) of the edges at frontier(center, id)."""
    f = frontier.select("center", F.col("id").alias("node")).join(F.broadcast(at.hubs) if at.few_hubs else at.hubs, "node", "left")
    f = f.select("center", "node", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return at.ends.join(F.broadcast(f) if few else f, ["node", "part"]).select("center", "other", "edge")


def heads(at: Layout, most: int) -> DataFrame:
    """(node, other, edge): each node's first neighbours by least edge, `most` of them."""
    least = at.ends.groupBy("node", "other").agg(F.min("edge").alias("edge"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("edge", "other"))
    return materialize(least.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "edge-heads")


def reach(nodes: DataFrame, at: Layout, centers: DataFrame, max_hops: int, hop_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(center, id, hop) and (center, omitted) for centers(center), as graph.reach for each."""
    start = centers.select(F.col("center").cast("bigint").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    frontier = materialize(start.select(F.col("id").alias("center"), "id", F.lit(0).alias("hop")), "hop")
    # A centre has visited itself and at most the limit a hop before.
    first = None if hop_limit is None else heads(at, hop_limit * max_hops + 1)
    visited, omitted, size = frontier, frontier.select("center", F.lit(0).cast("bigint").alias("omitted")), frontier.count()
    for hop in range(1, max_hops + 1):
        if not size:
            break
        few, seen = size <= ROWS_SENT, visited.select("center", "id")
        if first is None:
            around = _around(frontier, at, few)
        else:
            f = frontier.select("center", F.col("id").alias("node"))
            around = first.join(F.broadcast(f) if few else f, "node").select("center", "other", "edge")
        found = around.groupBy("center", F.col("other").alias("id")).agg(F.min("edge").alias("edge"))
        new = materialize(found.join(seen, ["center", "id"], "left_anti"), "hop-all")
        if hop_limit is not None:
            every = _around(frontier, at, few).select("center", F.col("other").alias("id")).distinct().join(seen, ["center", "id"], "left_anti")
            beyond = every.groupBy("center").agg(F.greatest(F.count("*") - hop_limit, F.lit(0)).alias("omitted"))
            omitted = omitted.unionByName(beyond)
            nth = F.row_number().over(Window.partitionBy("center").orderBy("edge", "id"))
            new = new.withColumn("nth", nth).where(F.col("nth") <= hop_limit)
        frontier = materialize(new.select("center", "id", F.lit(hop).alias("hop")), "hop")
        visited, size = visited.unionByName(frontier), frontier.count()
    return visited, omitted.groupBy("center").agg(F.sum("omitted").alias("omitted"))


def ambient_fill(nodes: DataFrame, visited: DataFrame, hop_limit: int | None = None) -> DataFrame:
    """(center, id, hop): for each centre the newest other nodes, as graph.ambient_fill.

    A centre with fewer nodes than the limit takes 15 at most, so only the newest limit + 15 nodes
    can be taken: a list whose length follows the limit, not the tables.
    """
    target = hop_limit or graph.AMBIENT_TARGET
    newest = [r[0] for r in nodes.select("id").orderBy(F.desc("id")).limit(target + graph.AMBIENT_MOST).collect()]
    counts = visited.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") < target)
    ids = F.array(*[F.lit(i) for i in newest]) if newest else F.array().cast("array<bigint>")
    rows = counts.select("center", F.least(F.lit(graph.AMBIENT_MOST), F.lit(target) - F.col("n")).alias("room"), F.explode(ids.cast("array<bigint>")).alias("id"))
    free = rows.join(visited.select("center", "id"), ["center", "id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("id")))
    return free.withColumn("nth", nth).where(F.col("nth") <= F.col("room")).select("center", "id", F.lit(graph.AMBIENT_RANK).alias("hop"))


def induced_edges(edges: DataFrame, at: Layout, members: DataFrame) -> DataFrame:
    """(center, edge columns, tier) of the edges with both ends among a centre's members(center, id, hop).

    Members look up their edges in the layout, where hubs are dealt into parts; of an edge, which is found from either end, the row from its source counts.
    """
    rank = members.select("center", "id", F.least("hop", F.lit(graph.AMBIENT_RANK)).alias("rank"))
    few = members.count() <= ROWS_SENT
    ends = _around(rank, at, few).distinct()
    both = ends.join(rank.select("center", F.col("id").alias("other")), ["center", "other"], "left_semi").select("center", F.col("edge").alias("id")).distinct()
    rows = edges.join(F.broadcast(both) if few else both, "id")
    s, t = (rank.select("center", F.col("id").alias(end), F.col("rank").alias(f"rank_{end}")) for end in ("source", "target"))
    rows = rows.join(s, ["center", "source"]).join(t, ["center", "target"])
    return rows.select("center", *[rows[c] for c in edges.columns], graph.tier_name(F.greatest("rank_source", "rank_target", F.lit(1))).alias("tier"))


@dataclass
class Neighbourhoods:
    """nodes(center, id, hop, tier), edges(center, ..., tier), omitted(center, omitted)."""

    nodes: DataFrame
    edges: DataFrame
    omitted: DataFrame


def subgraphs(nodes: DataFrame, edges: DataFrame, centers: DataFrame, max_hops: int = graph.UNBOUNDED_HOPS, hop_limit: int | None = graph.AMBIENT_TARGET, fill: bool = True, at: Layout | None = None) -> Neighbourhoods:
    """Neighbourhoods by tiers of all centers(center). at: a layout of the edges, if there is one already."""
    at = at or layout(edges)
    visited, omitted = reach(nodes, at, centers, max_hops, hop_limit)
    if fill:
        visited = visited.unionByName(ambient_fill(nodes, visited, hop_limit))
    visited = materialize(visited, "visited")
    return Neighbourhoods(visited.withColumn("tier", graph.tier_name(F.least("hop", F.lit(graph.AMBIENT_RANK)))), induced_edges(edges, at, visited), omitted)
