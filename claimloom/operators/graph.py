"""Reads on a property graph: nodes(id, name, classification, description, ...), edges(id, source, target, relation, ...)."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.order import fresh, row_numbers
from claimloom.plans.scratch import materialize

#: Tier of a node by the hop at which it is first reached; farther ones are ambient.
TIERS = {0: "SELF", 1: "DIRECT", 2: "TWO_HOP", 3: "THREE_HOP"}
AMBIENT = "AMBIENT"
AMBIENT_RANK = 4
AMBIENT_TARGET = 60
AMBIENT_MOST = 15
DEFAULT_HOPS, DEFAULT_LIMIT, UNBOUNDED_HOPS = 2, 35, 4


def tier_name(rank: Column) -> Column:
    """Name of a tier's rank."""
    out = F.lit(AMBIENT)
    for hop, name in TIERS.items():
        out = F.when(rank == hop, F.lit(name)).otherwise(out)
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """(edge, node, other): each edge once from either end, so that looking up a node's edges is one equi-join."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    return edges.select(F.col("id").alias("edge"), ends.alias("e")).select("edge", "e.node", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a self-loop has two."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node with most edge ends (ties: least id); without edges the newest node, with degree 0."""
    known = nodes.select("id", "name").join(degrees(edges), "id", "left")
    newest_first = F.when(F.col("degree").isNull(), -F.col("id")).otherwise(F.col("id"))
    return known.orderBy(F.desc_nulls_last("degree"), newest_first).limit(1).select("id", "name", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def resolve_limits(max_hops: int | None = None, hop_limit: int | None = None, unbounded: bool = False) -> tuple[int, int | None]:
    """Defaults of a neighbourhood request: 2 hops of at most 35 nodes, or 4 hops without a limit."""
    return max_hops if max_hops is not None else (UNBOUNDED_HOPS if unbounded else DEFAULT_HOPS), hop_limit if hop_limit is not None else (None if unbounded else DEFAULT_LIMIT)


@dataclass
class Subgraph:
    """nodes(id, hop, tier), edges(id, source, target, relation, tier), and how many nodes the limit left out."""

    nodes: DataFrame
    edges: DataFrame
    omitted: int


#: Nodes of a frontier that are broadcast to the edges; larger ones are joined by shuffle.
BROADCAST_FRONTIER = 1_000_000


def _around(edges: DataFrame, frontier: DataFrame, few: bool) -> DataFrame:
    """(edge, other): what the frontier's edges lead to. Semi-joins on either end, which Spark pushes down to the edges' own tables."""
    at = lambda end: frontier.select(F.col("node").alias(end))
    side = lambda near, far: edges.join(F.broadcast(at(near)) if few else at(near), near, "left_semi").select(F.col("id").alias("edge"), F.col(far).alias("other"))
    return side("source", "target").unionByName(side("target", "source"))


def reach(nodes: DataFrame, edges: DataFrame, center: int, max_hops: int, hop_limit: int | None = None) -> tuple[DataFrame, int]:
    """(id, hop) of nodes by the first hop that reaches them over edges in either direction, and the count left out.

    With a limit a hop keeps the nodes whose least edge id to the frontier is least (ties: least
    node id). Nodes left out may come back, or be left out and counted again, in later hops.

    A hop scans the edges for those at its frontier, which is broadcast up to BROADCAST_FRONTIER
    nodes, and writes only the nodes that it adds. A missing centre gives no rows.
    """
    frontier = materialize(nodes.where(F.col("id") == center).select("id", F.lit(0).alias("hop")).distinct(), "hop")
    visited, omitted, size = frontier, 0, 1
    for hop in range(1, max_hops + 1):
        new = _around(edges, frontier.select(F.col("id").alias("node")), size <= BROADCAST_FRONTIER).groupBy(F.col("other").alias("id")).agg(F.min("edge").alias("edge")).join(visited, "id", "left_anti")
        if hop_limit is not None:
            new = materialize(new, "hop-all")
            omitted += max(0, new.count() - hop_limit)
            new = new.orderBy("edge", "id").limit(hop_limit)
        frontier = materialize(new.select("id", F.lit(hop).alias("hop")), "hop")
        size = frontier.count()
        if not size:
            break
        visited = visited.unionByName(frontier)
    return visited, omitted


def ambient_fill(nodes: DataFrame, visited: DataFrame, hop_limit: int | None = None) -> DataFrame:
    """(id, hop): the newest other nodes, if fewer than the limit (or 60) are there, 15 at most. A limit of 0 counts as none."""
    room = min(AMBIENT_MOST, (hop_limit or AMBIENT_TARGET) - visited.count())
    if room <= 0:
        return nodes.where("false").select("id", F.lit(AMBIENT_RANK).alias("hop"))
    return nodes.join(visited, "id", "left_anti").orderBy(F.desc("id")).limit(room).select("id", F.lit(AMBIENT_RANK).alias("hop"))


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(id, hop), self-loops and parallel edges included, with the farther end's tier; DIRECT where both ends are the centre."""
    ends = members.select("id", F.least("hop", F.lit(AMBIENT_RANK)).alias("rank"))
    s = ends.withColumnsRenamed({"id": "source", "rank": "rank_s"})
    t = ends.withColumnsRenamed({"id": "target", "rank": "rank_t"})
    both = edges.join(s, "source").join(t, "target")
    return both.select(*[both[c] for c in edges.columns], tier_name(F.greatest("rank_s", "rank_t", F.lit(1))).alias("tier"))


def subgraph(nodes: DataFrame, edges: DataFrame, center: int, max_hops: int = UNBOUNDED_HOPS, hop_limit: int | None = AMBIENT_TARGET, fill: bool = True) -> Subgraph:
    """Neighbourhood of a node by tiers. A missing centre gives empty results."""
    visited, omitted = reach(nodes, edges, center, max_hops, hop_limit)
    if fill and not visited.isEmpty():
        visited = materialize(visited.unionByName(ambient_fill(nodes, visited, hop_limit)), "visited")
    return Subgraph(visited.withColumn("tier", tier_name(F.least("hop", F.lit(AMBIENT_RANK)))), induced_edges(edges, visited), omitted)


def scan_with_class(nodes: DataFrame, classifications: DataFrame, where: Column | None = None) -> DataFrame:
    """Nodes (where a condition on them holds) with `classification_name`, their classification's display name; an unknown code keeps its node, with null."""
    rows = nodes if where is None else nodes.where(where)
    names = classifications.select(F.col("code").alias("classification"), F.col("display_name").alias("classification_name"))
    return rows.join(names, "classification", "left").select(*[rows[c] for c in rows.columns], "classification_name")


def active_only(rows: DataFrame) -> DataFrame:
    """Rows whose is_active is true; unknown counts as not, repeated rows stay."""
    return rows.where(F.coalesce("is_active", F.lit(False)))


def node_view(members: DataFrame, nodes: DataFrame, classifications: DataFrame) -> DataFrame:
    """The rows that a neighbourhood shows: members(id, tier) with name, classification code and name, description, and properties (an empty object where there are none)."""
    rows = nodes.join(members.select("id", "tier"), "id")
    out = scan_with_class(rows, classifications)
    return out.select("id", "name", F.col("classification").alias("classification_code"), "classification_name", "description", F.coalesce("properties", F.lit("{}")).alias("properties"), "tier")


def edge_view(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """induced_edges with their relation's display name: (id, source_node_id, target_node_id, relation_code, relation_name, tier)."""
    names = relations.select(F.col("code").alias("relation"), F.col("display_name").alias("relation_name"))
    return edges.join(names, "relation", "left").select("id", F.col("source").alias("source_node_id"), F.col("target").alias("target_node_id"), F.col("relation").alias("relation_code"), "relation_name", "tier")


def node_details(nodes: DataFrame, classifications: DataFrame, claims: DataFrame, documents: DataFrame, insights: DataFrame, pairs: DataFrame, limit: int = 20) -> DataFrame:
    """One row per node: its class, newest claims with quote, statement and title, its insight and its questions in order.

    claims(id, document_id, quote_text, statement), insights(node_id, summary, issues),
    pairs(node_id, sequence, question, answer). Lists are cut before they are made.
    """
    found = evidence(nodes, claims, documents, limit).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("claim_id").alias("id"), F.col("quote_text").alias("quote"), "statement", "title"))).alias("claims"))
    out = scan_with_class(nodes, classifications).join(found.withColumnRenamed("node_id", "id"), "id", "left")
    out = out.join(insights.select(F.col("node_id").alias("id"), "summary", "issues"), "id", "left").join(question_lists(pairs).withColumnRenamed("node_id", "id"), "id", "left")
    return out.select("id", "name", "classification", "classification_name", "description", "claims", "summary", "issues", "questions")


def search(nodes: DataFrame, query: str, limit: int = 20, escape: bool = False) -> DataFrame:
    """Newest nodes whose name or description contains the trimmed query, in any case. % and _ are wildcards unless escape."""
    q = query.strip()
    if escape:
        hit = F.lower("name").contains(q.lower()) | F.lower("description").contains(q.lower())
    else:
        hit = F.col("name").ilike(f"%{q}%") | F.col("description").ilike(f"%{q}%")
    return nodes.where(hit).orderBy(F.desc("id")).limit(limit)


def first_names(nodes: DataFrame, limit: int = 60) -> DataFrame:
    """The oldest entities' names."""
    return nodes.select("id", "name").orderBy("id").limit(limit)


def evidence(nodes: DataFrame, claims: DataFrame, documents: DataFrame, limit: int = 20, missing_title: str = "Untitled document") -> DataFrame:
    """Newest claims of each node's claim_ids with their documents' titles: (node_id, claim_id, title, rank), and the claims' other columns but those of these names.

    A repeated reference counts once; references to no claim, and null lists, give nothing; a
    claim without a document has missing_title.
    """
    claims = claims.drop("node_id", "claim_id", "title", "rank")
    wanted = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(F.coalesce("claim_ids", F.array().cast("array<bigint>")))).alias("claim_id"))
    found = wanted.join(claims.withColumnRenamed("id", "claim_id"), "claim_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("claim_id")))).where(F.col("rank") <= limit)
    titles = documents.select(F.col("id").alias("document_id"), "title")
    return ranked.join(titles, "document_id", "left").withColumn("title", F.coalesce("title", F.lit(missing_title)))


#: Ends of edges that one task sorts, about 80 bytes each. Ids compress so well in a shuffle that its bytes say little of the memory that they take.
ENDS_OF_TASK = 1_000_000
#: Groups of nodes, by hash, whose ends are counted to find nodes with too many for a task.
END_GROUPS = 1 << 16


def incident_edges(edges: DataFrame, limit: int = 50, nodes: DataFrame | None = None) -> DataFrame:
    """(node, edge, rank): the first edges of each node by id; a self-loop once. nodes(id): of these at least; others may be left out.

    Ends are dealt by node over as many tasks as their number asks for. Those of a node (and of
    others of its hash) that has more than a task sorts are dealt by edge too, cut in each part,
    and then as a whole. Lists are cut before repeats are taken out.
    """
    ends = undirected(edges).select("node", "edge")
    if nodes is not None:
        wanted = materialize(nodes.select(F.col("id").alias("node")).distinct(), "ends-wanted")
        if wanted.count() <= BROADCAST_FRONTIER:  # else all ends are cut, which says the same of these
            ends = ends.join(F.broadcast(wanted), "node", "left_semi")
    ends = materialize(ends, "ends")
    group = F.pmod(F.xxhash64("node"), F.lit(END_GROUPS))
    crowded = [r[0] for r in ends.groupBy(group.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > ENDS_OF_TASK).select("g").collect()]  # one per ENDS_OF_TASK rows at most
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-ends.count() // ENDS_OF_TASK))

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        ranked = rows.repartition(tasks, *by).withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("edge")))
        return ranked.where(F.col("rank") <= limit).select("node", "edge", "rank").distinct()

    if not crowded:
        return first(ends, ["node"])
    many = group.isin(crowded)
    parts = first(ends.where(many).withColumn("part", F.pmod(F.xxhash64("edge"), F.lit(tasks))), ["node", "part"])
    return first(ends.where(~many), ["node"]).unionByName(first(parts.drop("rank"), ["node"]))


def insight_inputs(nodes: DataFrame, edges: DataFrame, most_claims: int = 100, most_edges: int = 50) -> DataFrame:
    """What an insight on a node is derived from: id, name, classification, description and properties as far as nodes have them, claim_ids, edge_ids, and a fingerprint of it all."""
    own = incident_edges(edges, most_edges, nodes).groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_list("edge")).alias("edge_ids"))
    none = F.array().cast("array<bigint>")
    known = [c for c in ("id", "name", "classification", "description", "properties") if c in nodes.columns]
    rows = nodes.join(own, "id", "left").select(*known, F.slice(F.array_sort(F.coalesce("claim_ids", none)), 1, most_claims).alias("claim_ids"), F.coalesce("edge_ids", none).alias("edge_ids"))
    return rows.withColumn("fingerprint", fingerprint(F.struct(*known, "claim_ids", "edge_ids")))


def fingerprint(value: Column) -> Column:
    """SHA-256 of a struct's JSON."""
    return F.sha2(F.to_json(value), 256)


def stale(inputs: DataFrame, insights: DataFrame) -> DataFrame:
    """Inputs whose fingerprint has no stored insight: the work that is left."""
    done = insights.select(F.col("node_id").alias("id"), F.col("input_fingerprint").alias("fingerprint"))
    return inputs.join(done, ["id", "fingerprint"], "left_anti")


def accept_fresh(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Derived results whose inputs haven't changed meanwhile."""
    return results.join(inputs.select(F.col("id").alias("node_id"), F.col("fingerprint").alias("input_fingerprint")), ["node_id", "input_fingerprint"], "left_semi")


def question_lists(pairs: DataFrame) -> DataFrame:
    """(node_id, questions): structs of sequence, question and answer in order."""
    return pairs.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "question", "answer"))).alias("questions"))


def merge_results(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows, and old ones that they don't replace, demoted to ambient."""
    return new.unionByName(old.join(new.select("id"), "id", "left_anti").withColumn("tier", F.lit("ambient")))


def encode_cursor(kind: str, scope: str, values: list) -> str:
    """Opaque text for a place in an ordered result."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "kind": kind, "scope": scope, "values": values}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, kind: str, scope: str, shape: tuple[type, ...]) -> list:
    """The values of a cursor; ValueError unless version, kind, scope and types are as expected."""
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    values = x.get("values") if isinstance(x, dict) else None
    if not isinstance(values, list) or x.get("v") != 1 or (x.get("kind"), x.get("scope")) != (kind, scope) or len(values) != len(shape) or any(type(v) is not t for v, t in zip(values, shape, strict=True)):
        raise ValueError("a cursor of another query")
    return values


def page_after(df: DataFrame, keys: list[str], values: list | None, size: int) -> DataFrame:
    """The next rows in order of keys after the given values (keyset paging)."""
    if values is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, values, strict=True)]))
    return df.orderBy(*keys).limit(size)


def pages(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """df with `page`, from 0: all pages that page_after gives from cursor to cursor, at once. Keys are unique."""
    nth = fresh(df, "nth")
    return row_numbers(df, [], keys, nth).withColumn("page", F.floor((F.col(nth) - 1) / size).cast("bigint")).drop(nth)


def prompt_text(inputs: DataFrame, claims: DataFrame, edges: DataFrame, reserved: list[str], most_claims: int = 30, most_edges: int = 20) -> DataFrame:
    """(id, prompt): name, description, shown properties, first claims and edges of each node, a line each.

    inputs(id, name, description, properties map, claim_ids, edge_ids), claims(id, statement), edges(id, source, target, relation).
    """
    wanted = inputs.select("id", F.posexplode(F.slice("claim_ids", 1, most_claims)).alias("n", "claim_id"))
    said = wanted.join(claims.select(F.col("id").alias("claim_id"), "statement"), "claim_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("claim: "), "statement").alias("line")))).alias("c"))
    near = inputs.select("id", F.posexplode(F.slice("edge_ids", 1, most_edges)).alias("n", "edge"))
    drawn = near.join(edges.select(F.col("id").alias("edge"), "source", "target", "relation"), "edge").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", F.lit("edge:"), "source", "relation", "target").alias("line")))).alias("e"))
    shown = F.map_filter("properties", lambda k, v: ~k.isin(reserved) & ~k.startswith("_") & v.isNotNull())
    own = F.transform(F.array_sort(F.map_entries(shown)), lambda p: F.concat(F.lit("property: "), p["key"], F.lit(" = "), p["value"]))
    lines = lambda a: F.coalesce(F.transform(a, lambda x: x["line"]), F.array().cast("array<string>"))
    out = inputs.join(said, "id", "left").join(drawn, "id", "left")
    head = F.array_compact(F.array(F.concat(F.lit("name: "), "name"), F.concat(F.lit("description: "), "description")))
    return out.select("id", F.array_join(F.concat(head, F.coalesce(own, F.array().cast("array<string>")), lines(F.col("c")), lines(F.col("e"))), "\n").alias("prompt"))
