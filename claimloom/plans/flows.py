"""Queries of sources, sinks, the write path, review bundles and insights over the given tables, each with its SQL equivalent.

What a sink writes is read back, so that a row shows what has been stored. Everything lies in the
shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import adapters, corpus, graph, grounding, ingest, insights, intake, producers, ranking, upkeep
from claimloom.operators.stored import GraphLedger
from claimloom.plans import derived
from claimloom.plans.derived import GRAPH_CTE, table
from claimloom.plans.queries import _HTML_TEXT, query
from claimloom.plans.scratch import materialize, passing_tables, scratch_path
from claimloom.sources import readers, writers
from claimloom.sources.ledger import Conflict, Ledger, Table
from claimloom.streaming import extraction

# Sources and sinks.

_CLASSES = "cl AS (SELECT DISTINCT classification AS code, upper(classification[1]) || lower(classification[2:]) AS display_name FROM nodes)"


def _classes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("classification").alias("code")).distinct().select("code", T.capitalized(F.col("code")).alias("display_name"))


@query("a1_nodes_with_class", f"{GRAPH_CTE}, {_CLASSES} SELECT id, name, classification, display_name AS classification_name FROM nodes JOIN cl ON code = classification")
def a1_nodes_with_class(spark, d):
    nodes = derived.nodes(spark, d)
    return graph.scan_with_class(nodes, _classes(nodes)).select("id", "name", "classification", "classification_name")


@query("a2_active_only", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def a2_active_only(spark, d):
    return graph.active_only(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"))).select("c_custkey")


@query("a3_candidate_file", "SELECT 'full_export' AS layout, 'http://h/' || event_id AS url, CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS has_sk FROM events")
def a3_candidate_file(spark, d):
    path, c = scratch_path(spark, "candidates"), F.col
    rows = table(spark, d, "events").select(
        F.lit("a").alias("query_interval_start"), F.lit("b").alias("query_interval_end"), c("ts").cast("string").alias("seen_at"), F.concat(F.lit("http://h/"), c("event_id").cast("string")).alias("url"),
        F.when(c("event_type") == "click", "1").otherwise("0").alias("has_sk"), *[F.lit("0").alias(x) for x in ("has_samsung", "has_intel", "has_nvidia")], F.lit("x").alias("more"),
    )
    rows.write.option("header", True).csv(path)
    layout, found = readers.candidates(spark, path)
    return found.select(F.lit(layout).alias("layout"), "url", "has_sk")


@query("a4_record_log", "SELECT user_id, event_id, event_type FROM events")
def a4_record_log(spark, d):
    path = scratch_path(spark, "log")
    writers.write_records(table(spark, d, "events").select("user_id", "event_id", "event_type"), path)
    return readers.record_log(spark, path, "user_id bigint, event_id bigint, event_type string").select("user_id", "event_id", "event_type")


@query("a6_exports", "SELECT conv_id, turn, role, text FROM conversations")
def a6_exports(spark, d):
    path = scratch_path(spark, "exports")
    turns = table(spark, d, "conversations")
    grouped = turns.groupBy(F.pmod("conv_id", F.lit(8)).alias("producer")).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("turns"))  # a producer's file holds its conversations
    grouped.repartition("producer").write.json(path)
    found = readers.exports(spark, path, "producer bigint, turns array<struct<conv_id: bigint, turn: int, role: string, text: string>>", lines=True)
    return found.select(F.explode("turns").alias("t")).select("t.*")


_HTML_TITLE = r"CASE WHEN regexp_matches(html, '(?i)<title>(.*?)</title>') THEN trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1), '" + T.WHITE + "') ELSE url END"


@query("a9_pages", f"SELECT url, {_HTML_TITLE} AS title, {_HTML_TEXT} AS content FROM pages")
def a9_pages(spark, d):
    return readers.pages(table(spark, d, "pages"))


@query(
    "a10_dispatch",
    f"""SELECT 'u' || page_id AS id, {_HTML_TITLE.replace('ELSE url END', "ELSE 'https://p/' || page_id END")} AS title, {_HTML_TEXT} AS content FROM pages WHERE page_id % 7 <> 3 UNION ALL SELECT 'u' || page_id, NULL, NULL FROM pages WHERE page_id % 7 = 3
UNION ALL SELECT 'd' || doc_id, CASE doc_id % 3 WHEN 0 THEN 'f' || doc_id || '.TXT' WHEN 1 THEN trim(replace(left(trim(coalesce(text, ''), '{T.WHITE}'), 30), chr(10), ' '), '{T.WHITE}') ELSE 'Text Document' END, CASE WHEN doc_id % 3 = 1 THEN trim(coalesce(text, ''), '{T.WHITE}') ELSE coalesce(text, '') END FROM documents""",
)
def a10_dispatch(spark, d):
    """Addresses (some not fetched), files with and without a name, and texts, each by its type."""
    p, docs, none = table(spark, d, "pages"), table(spark, d, "documents"), F.lit(None).cast("string")
    k = F.col("doc_id") % 3
    urls = p.select(F.concat(F.lit("u"), "page_id").alias("id"), F.lit("url").alias("source_type"), F.concat(F.lit(" "), F.concat(F.lit("https://p/"), F.col("page_id").cast("string")), F.lit("\n")).cast("binary").alias("data"), none.alias("name"))
    own = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.when(k == 1, "text").otherwise("file").alias("source_type"), F.col("text").cast("binary").alias("data"), F.when(k == 0, F.concat(F.lit("f"), "doc_id", F.lit(".TXT"))).otherwise("").alias("name"))
    fetched = p.where("page_id % 7 <> 3").select(F.concat(F.lit("https://p/"), F.col("page_id").cast("string")).alias("url"), "html")
    return readers.documents(urls.unionByName(own), fetched).select("id", "title", "content")


@query("a12_robots", "SELECT event_id, user_id % 3 <> 1 AS allowed, greatest(1.0::DOUBLE, (user_id % 4)::DOUBLE) AS delay FROM events")
def a12_robots(spark, d):
    origin = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example"))
    urls = table(spark, d, "events").select("event_id", F.concat(origin, F.lit(":443/"), F.col("event_id").cast("string")).alias("url"))
    files = table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example")).alias("origin"), F.when(F.col("user_id") % 3 == 0, 404).when(F.col("user_id") % 3 == 1, 503).otherwise(200).alias("robots_status"), (F.col("user_id") % 4).alias("delay"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("double").alias("requests"))
    return corpus.with_robots(urls, files).select("event_id", "allowed", "delay")


@query("a16_bodies", "SELECT sha256(text) AS sha, substr(sha256(text), 1, 2) AS shard, length(text)::INTEGER AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def a16_bodies(spark, d):
    path = scratch_path(spark, "bodies")
    bodies = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    writers.save_bodies(bodies.where("doc_id % 2 = 0").select("body"), path)
    writers.save_bodies(bodies.select("body"), path)  # adds only what isn't there
    return spark.read.parquet(path).select("sha", F.col("shard").cast("string").alias("shard"), F.length("body").alias("n"))


@query("a17_public_records", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'FAILED_HTTP' ELSE 'SELECTED' END AS status FROM events")
def a17_public_records(spark, d):
    path = scratch_path(spark, "records")
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", "RETRY_PENDING").otherwise("SELECTED").alias("status"))
    writers.write_records(writers.public_records(rows, ["event_id", "status"], "event_id"), path)
    return spark.read.schema("event_id bigint, status string").json(path)


@query("a18_audit_file", """SELECT doc_id::VARCHAR AS doc_id, source, 'a "b", c' || chr(10) || lang AS note, '' AS answer FROM documents""")
def a18_audit_file(spark, d):
    path = scratch_path(spark, "audit")
    writers.write_audit(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.concat(F.lit('a "b", c\n'), "lang").alias("note"), F.lit("").alias("answer")), path)
    return writers.read_audit(spark, path)


@query("a19_manifest", "SELECT 'changed' AS problem, 1::BIGINT AS n UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unexpected', 1")
def a19_manifest(spark, d):
    """Three files of the customers are tampered with in the manifest's copy: one changed, one left out, one made up."""
    path = scratch_path(spark, "published")
    table(spark, d, "customer").repartition(6, "c_nationkey").write.json(path)
    now = materialize(writers.manifest(spark, path), "manifest")
    names = now.where("NOT name LIKE '\\_%'").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    was = now.join(names).select(F.when(F.col("name") == F.col("low"), "gone").otherwise(F.col("name")).alias("name"), F.when(F.col("name") == F.col("high"), "0").otherwise(F.col("sha256")).alias("sha256"))  # one row of names
    return writers.manifest_problems(was, now).groupBy("problem").agg(F.count("*").alias("n"))


@query("a20_metadata", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS duplicates_merged FROM documents")
def a20_metadata(spark, d):
    text = writers.collection_metadata(table(spark, d, "documents"), "text")
    r = F.from_json(F.lit(text), "rows bigint, unique bigint, duplicates_merged bigint")
    return spark.range(1).select(r.alias("r")).select(F.col("r.rows").alias("n_rows"), F.col("r.unique").alias("n_unique"), "r.duplicates_merged")


@query("a20_snapshot_id", "SELECT true AS same_in_any_order, true AS other_for_other_rows")
def a20_snapshot_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = [writers.snapshot_id(x) for x in (docs, docs.repartition(7, "text"), docs.where("doc_id > 0"))]
    return spark.range(1).select(F.lit(ids[0] == ids[1]).alias("same_in_any_order"), F.lit(ids[0] != ids[2]).alias("other_for_other_rows"))


@query("b17_store_versions", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS priority FROM orders")
def b17_store_versions(spark, d):
    """A store of orders in three commits: all, a batch of changes twice, and a compaction."""
    store = writers.Store(spark, scratch_path(spark, "store"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    store.commit({"orders": orders.drop("o_orderstatus")})
    changed = orders.where("o_orderstatus = 'F'").select("id", F.lit("done").alias("priority"))
    for _ in range(2):  # the second time it is in the log already
        store.append({"orders": changed}, "stream", 0)
    store.compact()
    return store.table("orders")


# The write path: a payload per order, with its customer and suppliers as entities and its lines as claims.


def _order_payloads(spark, d, some: str = "true") -> DataFrame:
    lines = table(spark, d, "lineitem").where(some).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("seq"), F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"), "l_linenumber", "l_partkey")
    quote = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" by "), F.col("s").cast("string"))
    lines = lines.withColumn("quote", quote).withColumn("ref", F.concat_ws("-", F.lit("c"), "l_linenumber", "l_partkey", "s"))
    text, number, offset = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("int")
    supplier = F.concat(F.lit("S"), F.col("s").cast("string"))
    customer = F.concat(F.lit(" C"), F.col("c").cast("string"), F.lit("\t"))
    per = lines.groupBy("seq").agg(
        F.sort_array(F.collect_set(F.struct(F.concat(F.lit("s"), F.col("s").cast("string")).alias("ref_id"), supplier.alias("name"), F.lit("supplier").alias("classification"), text.alias("description"), text.alias("properties"), number.alias("existing_node_id"), F.lit("none").alias("claim_ref"), F.array().cast("array<string>").alias("claim_refs")))).alias("suppliers"),
        F.first(F.struct(F.lit("c").alias("ref_id"), customer.alias("name"), F.lit("customer").alias("classification"), text.alias("description"), text.alias("properties"), number.alias("existing_node_id"), text.alias("claim_ref"), F.array(F.lit("none")).alias("claim_refs"))).alias("customer"),
        F.sort_array(F.collect_list(F.struct(text.alias("source_ref"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("target_ref"), customer.alias("source_name"), text.alias("target_name"), F.lit(" buys_from").alias("relation"), F.col("ref").alias("claim_ref"), F.array("ref", F.lit("unknown")).alias("claim_refs")))).alias("edges"),
        F.sort_array(F.collect_list(F.struct(F.col("ref").alias("ref_id"), F.col("quote"), text.alias("claim_text"), offset.alias("start_offset"), offset.alias("end_offset")))).alias("claims"),
    )
    return per.select("seq", F.lit("orders").alias("source_project"), F.col("seq").cast("string").alias("document_title"), F.lit("part 1 by 1").alias("document_content"), F.concat(F.lit("o"), F.col("seq").cast("string")).alias("document_uri"), F.concat(F.array("customer"), F.col("suppliers")).alias("nodes"), "edges", "claims")


def _processed(spark, d, **limits: int) -> intake.Outcome:
    """All orders folded into nothing. Payloads are read whole once, so they are not written."""
    return intake.process(_order_payloads(spark, d), intake.empty_tables(spark), **limits)


def _last(spark, made: Callable[[], DataFrame]) -> DataFrame:
    """What is made, written; the tables on the way to it are deleted."""
    with passing_tables(spark) as keep:
        return keep(materialize(made(), "made"))


def _lines(some: str) -> str:
    return f"l AS (SELECT DISTINCT l_orderkey AS o, o_custkey AS c, l_suppkey AS s, 'part ' || l_partkey || ' by ' || l_suppkey AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {some})"


@query(
    "c18_intake_counters",
    f"""WITH {_lines('true')}, a AS (SELECT DISTINCT o, q FROM lineitem_a), b AS (SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT (SELECT count(DISTINCT o) FROM l) - (SELECT count(DISTINCT o) FROM a) AS documents_created, (SELECT count(*) FROM (SELECT DISTINCT o, q FROM l)) - (SELECT count(*) FROM a) AS claims_created,
(SELECT n FROM b) - ((SELECT count(*) FROM (SELECT DISTINCT o, q FROM l)) - (SELECT count(*) FROM a)) AS claims_reused""".replace("lineitem_a", f"(SELECT DISTINCT l_orderkey AS o, 'part ' || l_partkey || ' by ' || l_suppkey AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 3)"),
)
def c18_intake_counters(spark, d):
    """What a second batch makes, after a first with some of its lines."""
    with passing_tables(spark) as keep:
        first = intake.process(_order_payloads(spark, d, "l_linenumber <= 3"), intake.empty_tables(spark))
        stored = {k: keep(materialize(v, "stored")) for k, v in first.tables.items()}
    return _last(spark, lambda: intake.process(_order_payloads(spark, d), stored).counters.select("documents_created", "claims_created", "claims_reused"))


@query(
    "c13_intake_edges",
    f"""WITH {_lines('true')}, k AS (SELECT o, q, min(o) AS x FROM l GROUP BY 1, 2)
SELECT 'C' || c AS source, 'S' || s AS target, 'BUYS_FROM' AS relation, count(*) AS n_claims FROM (SELECT DISTINCT o, c, s, q FROM l) GROUP BY 1, 2""",
)
def c13_intake_edges(spark, d):
    """Edges of the graph with the number of their claims; references that no claim has are left out."""

    def found() -> DataFrame:
        t = _processed(spark, d).tables
        names = t["nodes"].select("id", "name")
        e = t["edges"].join(names.withColumnsRenamed({"id": "source", "name": "s"}), "source").join(names.withColumnsRenamed({"id": "target", "name": "t"}), "target")
        return e.select(F.col("s").alias("source"), F.col("t").alias("target"), "relation", F.size("claim_ids").cast("bigint").alias("n_claims"))

    return _last(spark, found)


@query(
    "c16_intake_evidence",
    f"""WITH {_lines('true')}, e AS (SELECT 'C' || c AS name, o, q FROM l UNION SELECT 'S' || s, o, q FROM l)
SELECT name, CASE WHEN name LIKE 'C%' THEN 'CUSTOMER' ELSE 'SUPPLIER' END AS classification, count(*) AS n_claims FROM e GROUP BY 1""",
)
def c16_intake_evidence(spark, d):
    """Entities with the number of claims that reach them through their edges: no reference or name leads to one."""
    return _last(spark, lambda: _processed(spark, d).tables["nodes"].select("name", "classification", F.size("claim_ids").cast("bigint").alias("n_claims")))


@query("c17_primary_nodes", f"WITH {_lines('true')} SELECT DISTINCT o AS seq, 'C' || c AS name FROM l")
def c17_primary_nodes(spark, d):
    """Each payload's primary entity: the first that has a reference."""

    def found() -> DataFrame:
        out = _processed(spark, d)
        names = out.tables["nodes"].select(F.col("id").alias("primary_node_id"), "name")
        return out.results.join(names, "primary_node_id").select("seq", "name")

    return _last(spark, found)


@query(
    "c4_c6_write_limits",
    f"""WITH {_lines('true')}, n AS (SELECT o, count(DISTINCT q) AS n FROM l GROUP BY 1)
SELECT o AS seq, CASE WHEN n > 3 THEN 'more than 3 claims of a document' WHEN r > 200 THEN 'more than 200 documents' ELSE '' END AS reason FROM (SELECT o, n, row_number() OVER (PARTITION BY n > 3 ORDER BY o) AS r FROM n)""",
)
def c4_c6_write_limits(spark, d):
    """What the write path's limits refuse: documents with too many claims, then documents beyond the room that is left; refused ones take none."""
    return _last(spark, lambda: _processed(spark, d, most_documents=200, most_claims=3).results.select("seq", F.coalesce("reason", F.lit("")).alias("reason")))


@query("c2_intake_codes", "SELECT 'BUYS_FROM' AS code, 'Buys_from' AS display_name UNION ALL SELECT 'CUSTOMER', 'Customer' UNION ALL SELECT 'SUPPLIER', 'Supplier'")
def c2_intake_codes(spark, d):
    t = _processed(spark, d).tables
    return t["classifications"].unionByName(t["relations"]).select("code", "display_name")


@query(
    "c16_ledger_fold",
    f"""WITH {_lines('true')}, e AS (SELECT 'C' || c AS name, o, q FROM l UNION SELECT 'S' || s, o, q FROM l)
SELECT name, CASE WHEN name LIKE 'C%' THEN 'CUSTOMER' ELSE 'SUPPLIER' END AS classification, count(*) AS n_claims FROM e GROUP BY 1""",
)
def c16_ledger_fold(spark, d):
    """The same graph from two overlapping batches, each in one commit of a bucketed ledger that holds evidence as links; the second comes twice."""
    led = GraphLedger(spark, scratch_path(spark, "ledger"))
    # A fold reads payloads whole once, and the texts of new documents: written, they would take more than the ledger.
    for batch, some in ((0, "l_linenumber <= 3"), (1, "true"), (1, "true")):
        with passing_tables(spark):
            intake.fold_into(_order_payloads(spark, d, some), led, "feed", batch)
    n = led.table("evidence").where("kind = 'node'").groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("n_claims"))
    return materialize(led.table("nodes").join(n, "id").select("name", "classification", "n_claims"), "folded")


@query(
    "c9_properties",
    """WITH e AS (SELECT user_id AS node_id, event_type AS k, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE event_id::VARCHAR END AS v, event_id AS n FROM events),
m AS (SELECT node_id, '{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}' AS metrics FROM (SELECT node_id, k, arg_max(v, n) AS v FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT m.node_id, metrics, f.first, CASE WHEN r.late THEN '"text"' ELSE '{}' END AS reports FROM m JOIN (SELECT node_id, arg_min(k, n) AS first FROM e GROUP BY 1) f ON f.node_id = m.node_id
JOIN (SELECT node_id, count(*) FILTER (n % 7 = 3) = 0 AS late FROM e GROUP BY 1) r ON r.node_id = m.node_id""",
)
def c9_properties(spark, d):
    """Patches of properties: first values stay, metrics merge key by key with a late null, a plain text under `reports` gives way to an empty object only."""
    events = table(spark, d, "events")
    value = F.when(F.col("event_id") % 5 == 0, "null").otherwise(F.col("event_id").cast("string"))
    reports = F.when(F.col("event_id") % 7 == 3, "{}").otherwise('"text"')
    patch = F.concat(F.lit('{"first":"'), "event_type", F.lit('","metrics":{"'), "event_type", F.lit('":'), value, F.lit('},"reports":'), reports, F.lit("}"))
    rows = events.select(F.col("user_id").alias("node_id"), patch.alias("properties"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.lit(False).alias("creates"))
    p = intake.merged_properties(rows).withColumn("p", F.from_json("properties", "first string, metrics variant, reports variant"))
    return p.select("node_id", F.to_json("p.metrics").alias("metrics"), "p.first", F.to_json("p.reports").alias("reports"))


# Upkeep of a ledger: customers and suppliers with an edge for each pair that traded, and an order's line with a supplier as a claim.

_TRADE = "x AS (SELECT DISTINCT l_orderkey AS o, o_custkey AS c, l_suppkey AS s, o_orderstatus AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_SUPPLIER_ID = 1_000_000_000


def _customer(key: Column) -> Column:
    """A customer's node: even, so that no key, however large, is a supplier's."""
    return key.cast("bigint") * 2


def _supplier(key: Column) -> Column:
    return key.cast("bigint") * 2 + 1


def _shown(node: Column) -> Column:
    """A node's id as the queries give it: a customer's key, or a supplier's behind _SUPPLIER_ID."""
    return F.shiftright(node, 1) + F.when(node % 2 == 0, 0).otherwise(_SUPPLIER_ID)


def _pair(a: Column, b: Column) -> Column:
    """One number of two keys below 2^32, another for each pair."""
    return F.shiftleft(a.cast("bigint"), 32) + b


def _trade_ledger(spark, d) -> GraphLedger:
    led = GraphLedger(spark, scratch_path(spark, "trade"))
    with passing_tables(spark):
        _trade_into(spark, d, led)
    return led


def _trade_into(spark, d, led: GraphLedger) -> None:
    orders = table(spark, d, "orders")
    x = table(spark, d, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()
    x = materialize(x.select("o", _customer(F.col("c")).alias("c"), _supplier(F.col("s")).alias("s"), _pair(F.col("o"), F.col("s")).alias("claim_id"), _pair(F.col("c"), F.col("s")).alias("e")), "trade")
    none = F.lit(None).cast("string")
    documents = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("normalized_content"), F.concat(F.lit("o"), "o_orderkey").alias("source_uri"))
    claims = x.select(F.col("claim_id").alias("id"), F.col("o").alias("document_id"), F.concat(F.lit("by "), "s").alias("quote_text"), F.lit("s").alias("statement"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    node = lambda c, letter, code: x.select(F.col(c).alias("id")).distinct().select("id", F.concat(F.lit(letter), "id").alias("name"), F.lit(code).alias("classification"), none.alias("description"), none.alias("properties"))
    edges = x.groupBy("e").agg(F.first("c").alias("source"), F.first("s").alias("target"), F.min("claim_id").alias("claim_id")).select(F.col("e").alias("id"), "source", "target", F.lit("TRADES").alias("relation"), "claim_id")
    links = x.select(F.explode(F.array(F.struct(F.lit("node").alias("kind"), F.col("c").alias("owner_id")), F.struct(F.lit("node").alias("kind"), F.col("s").alias("owner_id")), F.struct(F.lit("edge").alias("kind"), F.col("e").alias("owner_id")))).alias("k"), "claim_id").select("k.*", "claim_id")
    codes = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    classes = codes.where("id < 2").select((F.col("id") + 1).alias("id"), F.when(F.col("id") == 0, "CUSTOMER").otherwise("SUPPLIER").alias("code"), F.lit("").alias("display_name"))
    nodes = node("c", "C", "CUSTOMER").unionByName(node("s", "S", "SUPPLIER"))
    intake.ledger_of({"documents": documents, "claims": claims, "nodes": nodes, "edges": edges, "classifications": classes, "relations": classes.where("id = 1").withColumn("code", F.lit("TRADES"))}, led, links)


@query(
    "a15_ledger_cascade",
    f"""WITH {_TRADE}, k AS (SELECT x.* FROM x JOIN customer ON c_custkey = c WHERE c_acctbal >= 0)
SELECT {_SUPPLIER_ID} + s AS id, count(DISTINCT c) FILTER (kept) AS n_edges, count(*) AS n_claims, count(*) FILTER (kept) AS n_edge_claims FROM (SELECT x.*, c_acctbal >= 0 AS kept FROM x JOIN customer ON c_custkey = c) GROUP BY s""",
)
def a15_ledger_cascade(spark, d):
    """Customers in debt are deleted in one commit: their edges and the evidence of both go; suppliers keep their own."""
    led = _trade_ledger(spark, d)
    upkeep.delete_nodes(led, table(spark, d, "customer").where("c_acctbal < 0").select(_customer(F.col("c_custkey")).alias("id")))
    links = led.table("evidence")
    edges = led.table("edges").select(F.col("id").alias("e"), F.col("target").alias("id"))
    per_edge = links.where("kind = 'edge'").groupBy(F.col("owner_id").alias("e")).agg(F.count("*").alias("n"))
    n_edges = edges.join(per_edge, "e", "left").groupBy("id").agg(F.count("*").alias("n_edges"), F.sum("n").alias("n_edge_claims"))
    own = links.where("kind = 'node'").groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("n_claims"))
    out = led.table("nodes").where("classification = 'SUPPLIER'").select("id").join(n_edges, "id", "left").join(own, "id", "left")
    return materialize(out.select(_shown(F.col("id")).alias("id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_edges", "n_claims", "n_edge_claims"))), "cascaded")


@query(
    "c21_ledger_orphans",
    f"""WITH {_TRADE}, k AS (SELECT * FROM x WHERE status <> 'F')
SELECT c AS id, count(*) AS n_claims, count(DISTINCT s) AS n_edges FROM k GROUP BY 1 UNION ALL SELECT {_SUPPLIER_ID} + s, count(*), count(DISTINCT c) FROM k GROUP BY 1""",
)
def c21_ledger_orphans(spark, d):
    """Finished orders are deleted with their claims; then nodes without evidence, with their edges; edges that lost all evidence but not their ends are left out of the count."""
    led = _trade_ledger(spark, d)
    upkeep.delete_documents(led, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    upkeep.delete_orphans(led)
    links = led.table("evidence")
    own = links.where("kind = 'node'").groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("n_claims"))
    held = led.table("edges").join(links.where("kind = 'edge'").select(F.col("owner_id").alias("id")).distinct(), "id", "left_semi")
    n = held.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
    return materialize(led.table("nodes").select("id").join(own, "id", "left").join(n, "id", "left").withColumn("id", _shown(F.col("id"))), "held")


@query(
    "d12_ledger_insights",
    f"SELECT {_SUPPLIER_ID} + s_suppkey AS node_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS summary, CASE WHEN s_suppkey % 2 = 0 THEN 'n0' ELSE 'q0,q1,q2' END AS questions FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AND s_suppkey % 3 <> 0",
)
def d12_ledger_insights(spark, d):
    """Insights of all suppliers; those of every second are replaced with all their questions; every third is deleted, and a late result doesn't bring it back."""
    led = _trade_ledger(spark, d)
    k = F.shiftright("node_id", 1)
    owners = materialize(table(spark, d, "supplier").select(_supplier(F.col("s_suppkey")).alias("node_id")), "owners")
    made = lambda df, text: df.select("node_id", F.lit(text).alias("summary"), F.lit("").alias("history"), F.array().cast("array<string>").alias("issues"), F.lit("f").alias("input_fingerprint"))
    asked = lambda df, letter, n: df.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sequence")).select("node_id", "sequence", F.concat(F.lit(letter), "sequence").alias("question"), F.lit("a").alias("answer"))
    upkeep.replace_insights(led, made(owners, "old"), asked(owners, "q", 3))
    upkeep.delete_nodes(led, owners.where(k % 3 == 0).select(F.col("node_id").alias("id")))
    second = owners.where(k % 2 == 0)
    upkeep.replace_insights(led, made(second, "new"), asked(second, "n", 1))
    q = led.table("questions").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("question")), ",").alias("questions"))
    return materialize(led.table("insights").join(q, "node_id").select(_shown(F.col("node_id")).alias("node_id"), "summary", "questions"), "insights")


@query(
    "b9_followed_counts",
    f"""WITH {_TRADE}, k AS (SELECT DISTINCT c, s FROM x JOIN customer ON c_custkey = c WHERE c_acctbal >= 0), n AS (SELECT c AS id FROM x JOIN customer ON c_custkey = c WHERE c_acctbal >= 0 UNION SELECT {_SUPPLIER_ID} + s FROM x)
SELECT 'degree' AS kind, id::VARCHAR AS value, count(*) AS n FROM (SELECT c AS id FROM k UNION ALL SELECT {_SUPPLIER_ID} + s FROM k) GROUP BY 2 UNION ALL SELECT 'class', CASE WHEN id < {_SUPPLIER_ID} THEN 'CUSTOMER' ELSE 'SUPPLIER' END, count(*) FROM n GROUP BY 2""",
)
def b9_followed_counts(spark, d):
    """Degrees and classes, counted once and then by the signed differences of a commit that deletes nodes; equal to a recount."""
    led = _trade_ledger(spark, d)
    counts = Ledger(spark, scratch_path(spark, "counts"), {"degree": upkeep.Count.table("bigint"), "class": upkeep.Count.table("string")})
    kept = (upkeep.Count("edges", F.array("source", "target"), "degree"), upkeep.Count("nodes", F.col("classification"), "class"))
    for step in range(2):
        if step:
            upkeep.delete_nodes(led, table(spark, d, "customer").where("c_acctbal < 0").select(_customer(F.col("c_custkey")).alias("id")))
        for c in kept:
            upkeep.follow(led, counts, c)
    value = {"degree": _shown(F.col("value")).cast("string"), "class": F.col("value")}
    out = [counts.table(c.into).select(F.lit(c.into).alias("kind"), value[c.into].alias("value"), "n") for c in kept]
    return materialize(out[0].unionByName(out[1]), "followed")


@query("c20_two_writers", "SELECT o_orderkey AS id, o_orderstatus AS written_by FROM orders WHERE o_orderstatus IN ('F', 'O')")
def c20_two_writers(spark, d):
    """Two writers start from one version; the second is refused, starts again from the first's, and both are read back."""
    tables = {"orders": Table("id bigint, written_by string", ("id",), ("id",))}
    path = scratch_path(spark, "writers")
    one, two = Ledger(spark, path, tables), Ledger(spark, path, tables)
    rows = lambda s: {"orders": table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("written_by"))}
    base = two.version()
    one.commit(rows("F"), based_on=base)
    try:
        two.commit(rows("O"), based_on=base)
        raise AssertionError("a lost commit")
    except Conflict:
        two.commit(rows("O"), based_on=two.version())
    return two.table("orders")


# Extraction: conversations as documents, whose responses name their roles and quote their turns.


def _responses(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    claims = F.array_sort(F.collect_list(F.struct("turn", F.struct(F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("quote"), F.concat_ws(" ", F.lit("said by"), "role").alias("claim_text")).alias("c"))))
    docs = turns.groupBy("conv_id").agg(claims["c"].alias("claims"), F.array_sort(F.collect_set("role")).alias("roles"), F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("turn", "text")))["text"]).alias("content"))
    nodes = F.transform("roles", lambda r: F.struct(r.alias("name"), F.lit("person").alias("classification"), F.lit("a role").alias("description")))
    edges = F.transform("roles", lambda r: F.struct(r.alias("source_name"), F.lit("Known").alias("target_name"), F.lit("knows").alias("relation")))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"), "claims")), F.lit("\n```"))
    raw = F.when(F.col("conv_id") % 10 == 9, "sorry").otherwise(answer)
    return docs.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), "content", raw.alias("raw_response"))


def _grounded(spark, d) -> extraction.Grounded:
    return extraction.grounded(materialize(_responses(spark, d), "responses"), spark.createDataFrame([("KNOWN",)], "name string"))


@query("d1_d2_claims", f"SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INTEGER AS pos, trim(text, '{T.WHITE}') AS quote, 'said by ' || role AS claim_text FROM conversations WHERE conv_id % 10 <> 9")
def d1_d2_claims(spark, d):
    """Responses without their fences, decoded, with a row per claim."""
    return _grounded(spark, d)["claims"].select("doc_id", "pos", "quote", "claim_text")


@query("d3_rejected_responses", "SELECT DISTINCT conv_id AS doc_id, 'response is no JSON' AS reason FROM conversations WHERE conv_id % 10 = 9")
def d3_rejected_responses(spark, d):
    return _grounded(spark, d)["rejected"]


@query("d6_entity_refs", "SELECT conv_id AS doc_id, role AS name, 'n' || (row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1) AS ref_id FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE conv_id % 10 <> 9)")
def d6_entity_refs(spark, d):
    return _grounded(spark, d)["entities"].select("doc_id", "name", "ref_id")


@query(
    "d15_extraction_to_graph",
    """WITH c AS (SELECT DISTINCT conv_id, role, trim(text) AS q FROM conversations WHERE conv_id % 10 <> 9)
SELECT role AS name, 'PERSON' AS classification, '인물' AS display_name, count(DISTINCT conv_id) AS n_documents FROM c GROUP BY 1 UNION ALL SELECT 'Known', 'GENERAL', '일반', count(DISTINCT conv_id) FROM c""",
)
def d15_extraction_to_graph(spark, d):
    """Responses to graph: grounded, made payloads, folded into a ledger as a stream of batches, twice. A node counts the documents of its claims."""
    path = scratch_path(spark, "landing")
    _responses(spark, d).write.json(path)
    led = GraphLedger(spark, scratch_path(spark, "graph"))
    tables = intake.empty_tables(spark)
    tables["nodes"] = spark.createDataFrame([(1, "Known", "GENERAL", None, None, [])], intake.TABLES["nodes"])
    tables["classifications"] = spark.createDataFrame([(1, "GENERAL", "일반")], intake.TABLES["classifications"])
    intake.ledger_of(tables, led)
    for _ in range(2):  # a second start finds nothing new
        extraction.run_into(extraction.responses(spark, path), led, "chats", f"{path}-state").awaitTermination()
    nodes, claims = led.table("nodes"), led.table("claims")
    held = led.table("evidence").where("kind = 'node'").select(F.col("owner_id").alias("id"), "claim_id").join(claims.select(F.col("id").alias("claim_id"), "document_id"), "claim_id").groupBy("id").agg(F.countDistinct("document_id").alias("n_documents"))
    return graph.scan_with_class(nodes, led.table("classifications")).join(held, "id").select("name", "classification", F.col("classification_name").alias("display_name"), "n_documents")


# Insights: suppliers, with their orders as claims.


def _supplier_nodes(spark, d) -> DataFrame:
    claims = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_orderkey").alias("claim_ids"))
    nodes = derived.nodes(spark, d).where("classification IN ('SUPPLIER', 'NATION')").join(claims, "k", "left")
    return nodes.withColumn("claim_ids", F.when(F.col("classification") == "SUPPLIER", F.col("claim_ids"))).withColumn("properties", F.create_map(F.lit("class"), F.col("classification")))


@query(
    "d16_insights",
    f"""{GRAPH_CTE}, s AS (SELECT id, k FROM nodes WHERE classification = 'SUPPLIER'), b AS (SELECT id FROM nodes WHERE classification = 'NATION')
SELECT id AS node_id, CASE WHEN k % 5 = 0 THEN 'old' ELSE 'new ' || k END AS summary, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS n_issues, CASE WHEN k % 5 = 0 THEN 1 ELSE 1 END AS n_pairs FROM s WHERE k % 5 <> 1
UNION ALL SELECT id, 'There isn''t enough evidence for an analysis yet.', 0, 0 FROM b""",
)
def d16_insights(spark, d):
    """A round of insights: cached ones stay, nations have no evidence, and of the responses some are bad (with and without an older result)."""
    nodes, edges = materialize(_supplier_nodes(spark, d), "nodes"), materialize(derived.edges(spark, d), "edges")
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("statement"))
    none = F.array().cast("array<string>")
    held = nodes.where("classification = 'SUPPLIER' AND k % 5 = 0").select(F.col("id").alias("node_id"), F.lit("old").alias("summary"), F.lit("").alias("history"), none.alias("issues"), F.lit("x").alias("input_fingerprint"))
    pairs = held.select("node_id", F.lit(0).alias("sequence"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    w = insights.work(nodes, edges, claims, held)
    k = F.col("id") - 4_000_000_000
    answer = F.to_json(F.struct(F.concat(F.lit("new "), k.cast("string")).alias("overall_insight"), F.array(F.lit("i"), F.lit("j"), F.lit("k")).alias("issues"), F.array(F.struct(F.lit(" q ").alias("question"), F.lit("a").alias("answer")), F.struct(F.lit("x").alias("question"), F.lit("\t").alias("answer")), F.struct(F.lit("y").alias("question"), F.lit("z").alias("answer"))).alias("qa_pairs")))
    raw = F.when(k % 5 < 2, "no json").otherwise(answer)
    responses = w.prompts.select(F.col("id").alias("node_id"), F.col("fingerprint").alias("input_fingerprint"), raw.alias("raw_response"))
    out, questions, _ = insights.replace(held, pairs, w.bare, responses, w.inputs, most=2)
    n = questions.groupBy("node_id").agg(F.count("*").cast("int").alias("n_pairs"))
    return out.join(n, "node_id", "left").select("node_id", "summary", F.size("issues").alias("n_issues"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


_SUPPLIER_CLAIMS = "c AS (SELECT DISTINCT 4000000000 + l_suppkey AS id, l_orderkey AS claim_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY claim_id DESC) AS n FROM c), t AS (SELECT id, string_agg(claim_id::VARCHAR || ':' || coalesce(o_orderpriority, 'Untitled document'), ',' ORDER BY n) AS claims FROM r LEFT JOIN orders ON o_orderkey = claim_id WHERE n <= 20 GROUP BY 1)"


@query(
    "b11_node_details",
    f"{GRAPH_CTE}, {_SUPPLIER_CLAIMS} SELECT n.id, 'Supplier' AS classification_name, coalesce(t.claims, '') AS claims, CASE WHEN k % 2 = 0 THEN 'sum' ELSE '' END AS summary, CASE WHEN k % 3 = 0 THEN '0:q0,1:q1' ELSE '' END AS questions FROM nodes n LEFT JOIN t ON t.id = n.id WHERE classification = 'SUPPLIER'",
)
def b11_node_details(spark, d):
    nodes = materialize(_supplier_nodes(spark, d).where("classification = 'SUPPLIER'"), "nodes")
    orders = table(spark, d, "orders")
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("document_id")).distinct().withColumns({"quote_text": F.lit("q"), "statement": F.lit("s")})
    found = nodes.where("k % 2 = 0").select(F.col("id").alias("node_id"), F.lit("sum").alias("summary"), F.array(F.lit("i")).alias("issues"))
    asked = nodes.where("k % 3 = 0").select(F.col("id").alias("node_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("sequence")).select("node_id", "sequence", F.concat(F.lit("q"), F.col("sequence").cast("string")).alias("question"), F.lit("a").alias("answer"))
    out = graph.node_details(nodes, _classes(nodes), claims, orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")), found, asked)
    shown = F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["id"].cast("string"), c["title"])), ",")
    pairs = F.array_join(F.transform("questions", lambda q: F.concat_ws(":", q["sequence"].cast("string"), q["question"])), ",")
    return out.select("id", "classification_name", F.coalesce(shown, F.lit("")).alias("claims"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce(pairs, F.lit("")).alias("questions"))


@query(
    "b8_node_view",
    f"{GRAPH_CTE}, {_CLASSES} SELECT id, name, classification AS classification_code, display_name AS classification_name, description, '{{}}' AS properties, CASE WHEN k % 2 = 0 THEN 'DIRECT' ELSE 'AMBIENT' END AS tier FROM nodes JOIN cl ON code = classification WHERE k % 3 <> 0",
)
def b8_node_view(spark, d):
    nodes = derived.nodes(spark, d)
    members = nodes.where("k % 3 <> 0").select("id", F.when(F.col("k") % 2 == 0, "DIRECT").otherwise("AMBIENT").alias("tier"))
    return graph.node_view(members, nodes.withColumn("properties", F.lit(None).cast("string")), _classes(nodes))


@query(
    "b8_edge_view",
    f"{GRAPH_CTE} SELECT e.id, source AS source_node_id, target AS target_node_id, relation AS relation_code, CASE relation WHEN 'SUPPLIES' THEN 'Supplies' ELSE 'Located_in' END AS relation_name, 'DIRECT' AS tier FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.k % 3 <> 0 AND t.k % 3 <> 0",
)
def b8_edge_view(spark, d):
    edges = derived.edges(spark, d)
    members = derived.nodes(spark, d).where("k % 3 <> 0").select("id", F.lit(1).alias("hop"))
    relations = edges.select(F.col("relation").alias("code")).distinct().select("code", T.capitalized(F.col("code")).alias("display_name"))
    return graph.edge_view(graph.induced_edges(edges, members), relations)


@query("b21_task_listing", "SELECT o_orderkey AS id, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place, coalesce(n, 0)::INTEGER AS node_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY place LIMIT 100")
def b21_task_listing(spark, d):
    """The newest 100 tasks."""
    from pyspark.sql import Window

    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("nodes"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")).join(found, "id", "left").withColumn("edges", F.lit(None).cast("array<bigint>"))
    out = ranking.task_listing(tasks, 100)
    return out.select("id", "status", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("bigint").alias("place"), "node_count")


# Producers' exports and review.


def _news(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations")
    sentences = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("index"), "text")))
    points = F.transform(sentences, lambda s: F.struct(F.concat(F.lit("point "), s["index"].cast("string")).alias("text"), F.array(F.when(F.col("conv_id") % 10 == 1, s["index"] + 100).otherwise(s["index"])).alias("evidence")))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(sentences.alias("sentences")).withColumn("conv_id", F.col("id")).select("id", F.when(F.col("id") % 10 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("analysisArticleId"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("body").alias("bodyText"), F.lit(None).cast("string").alias("url"), "sentences", F.transform("sentences", lambda s: F.struct(F.concat(F.lit("point "), s["index"].cast("string")).alias("text"), F.array(F.when(F.col("conv_id") % 10 == 1, s["index"] + 100).otherwise(s["index"])).alias("evidence"))).alias("keyPoints"))


@query("e2_news_errors", "SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 10 = 0 THEN 'ANALYSIS_SOURCE_MISMATCH' WHEN conv_id % 10 = 1 THEN 'MISSING_EVIDENCE_REFERENCE' ELSE '' END AS error FROM conversations")
def e2_news_errors(spark, d):
    return adapters.news_errors(_news(spark, d)).select("id", F.coalesce("error", F.lit("")).alias("error"))


@query("e3_evidence_sentences", "SELECT conv_id AS item_id, turn AS point, turn::BIGINT AS index, text FROM conversations")
def e3_evidence_sentences(spark, d):
    turns = table(spark, d, "conversations")
    points = turns.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("point"), F.array("turn").alias("evidence"))
    return adapters.sentence_texts(points, turns.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("index"), "text"))


def _notices(spark, d) -> DataFrame:
    c = F.col
    snapshots = F.when(c("o_orderkey") % 3 != 0, F.array(F.struct(F.lit("notice").alias("title"), F.concat(F.lit("body "), c("o_orderkey").cast("string")).alias("text")))).otherwise(F.array().cast("array<struct<title: string, text: string>>"))
    finding = lambda q, m: F.struct(F.lit(q + "!").alias("statement"), F.lit(q).alias("quote"), F.lit(m).alias("modality"))
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), (c("o_orderkey") % 7).alias("detectionId"), F.lit(1).alias("documentId"), F.lit(2).alias("versionId"), F.lit("N").alias("title"), snapshots.alias("snapshots"),
        F.lit(None).cast("string").alias("local"), F.when(c("o_orderkey") % 2 == 0, '{"strategy": 1}').alias("preparation"), F.array(finding("runs", "FACT"), finding("should", "RECOMMENDATION"), finding("may", "CONDITIONAL_REQUIREMENT"), finding("?", "GUESS")).alias("findings"),
    )


_NOTICE = "n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'MISSING_GOV_IDENTIFIER' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'MISSING_NOTICE_BODY' END AS error FROM orders)"


@query("e4_notice_errors", f"WITH {_NOTICE} SELECT id, error FROM n WHERE error IS NOT NULL")
def e4_notice_errors(spark, d):
    return adapters.gov_bundle(_notices(spark, d))[2]


@query(
    "e16_notice_claims",
    f"WITH {_NOTICE}, f AS (SELECT * FROM (VALUES (0, 'gov-body', 'graph'), (1, 'gov-report', 'external_analysis_only'), (2, 'gov-body', 'node_panel_only'), (3, 'gov-body', 'rejected')) v(pos, document, destination)) SELECT id AS bundle, document, pos, destination FROM n, f WHERE error IS NULL",
)
def e16_notice_claims(spark, d):
    return adapters.gov_bundle(_notices(spark, d))[1].select("bundle", "document", "pos", "destination")


@query("e16_notice_documents", f"WITH {_NOTICE} SELECT id AS bundle, 'gov-body' AS document, CASE WHEN id % 3 <> 0 THEN 'body ' || id ELSE '' END AS content FROM n WHERE error IS NULL UNION ALL SELECT id, 'gov-report', CASE WHEN id % 2 = 0 THEN '{{\"strategy\": 1}}' ELSE '{{}}' END FROM n WHERE error IS NULL")
def e16_notice_documents(spark, d):
    return adapters.gov_bundle(_notices(spark, d))[0].select("bundle", "document", F.coalesce("content", F.lit("")).alias("content"))


@query("e6_workbook_cells", "SELECT l_orderkey AS workbook, 'Lines' AS sheet, 'A' || l_linenumber AS address, max(l_partkey::VARCHAR) AS value FROM lineitem GROUP BY 1, 3")
def e6_workbook_cells(spark, d):
    lines = table(spark, d, "lineitem")
    cell = F.struct(F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("address"), F.col("l_partkey").cast("string").alias("value"))
    rows = F.array_sort(F.collect_list(cell))  # of equal addresses the largest value comes last
    regions = F.array(F.struct(F.array(rows).alias("previewRows")))
    sheets = F.array(F.struct(F.lit("Lines").alias("name"), regions.alias("regions"), F.lit(None).cast(adapters._BLOCKS).alias("tables")))
    books = lines.groupBy(F.col("l_orderkey").alias("workbook")).agg(sheets.alias("sheets"))
    return adapters.cell_index(adapters.workbook_cells(books))


def _books(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = table(spark, d, "part")
    books = parts.select(F.col("p_partkey").alias("workbook"), F.when(F.col("p_size") == 1, "2.0").otherwise("1.0").alias("schema_version"))
    cell = lambda address, value: F.struct(F.lit(address).alias("address"), value.cast("string").alias("value"))
    at = F.explode(F.array(cell("B3", F.col("p_size") - 2), cell("C3", F.col("p_size") + 8), cell("C2", F.when(F.col("p_partkey") % 4 != 0, F.lit(2025))))).alias("c")
    cells = parts.select(F.col("p_partkey").alias("workbook"), at).select("workbook", F.lit("S").alias("sheet"), "c.address", "c.value")
    heads = parts.where("p_partkey % 8 = 0").select(F.col("p_partkey").alias("workbook"), F.lit("S").alias("sheet"), F.lit("C").alias("column"), F.lit("2025").alias("label"))
    return books, cells, heads


_BOOK = "b AS (SELECT p_partkey AS workbook, p_size - 2 AS was, p_size + 8 AS now, CASE WHEN p_size = 1 THEN 'UNSUPPORTED_SCHEMA' WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 0 THEN 'MISSING_PERIOD_REFERENCE' END AS error FROM part)"


@query("e17_workbook_claims", f"WITH {_BOOK} SELECT workbook AS bundle, 'e-c1' AS ref, 'FACT' AS modality, 'revenue is ' || now || '.0' AS statement FROM b WHERE error IS NULL UNION ALL SELECT workbook, 'e-c2', 'DERIVED_FACT', 'revenue grew by ' || trunc((now - was)::DOUBLE / was * 100)::INTEGER || '%' FROM b WHERE error IS NULL AND was <> 0")
def e17_workbook_claims(spark, d):
    return adapters.workbook_bundle(*_books(spark, d), "S", "C2", "B3", "C3", "Acme", "revenue")[1].select("bundle", "ref", "modality", "statement")


@query("e17_workbook_changes", f"WITH {_BOOK} SELECT workbook AS node_id, was::DOUBLE AS before, now::DOUBLE AS after, 'e-c1' AS refs FROM b WHERE error IS NULL")
def e17_workbook_changes(spark, d):
    return adapters.workbook_bundle(*_books(spark, d), "S", "C2", "B3", "C3", "Acme", "revenue")[2].select("node_id", "before", "after", F.array_join("claim_refs", ",").alias("refs"))


@query("e17_workbook_errors", f"WITH {_BOOK} SELECT workbook, error FROM b WHERE error IS NOT NULL")
def e17_workbook_errors(spark, d):
    return adapters.workbook_bundle(*_books(spark, d), "S", "C2", "B3", "C3", "Acme", "revenue")[3]


@query(
    "e11_producers",
    f"WITH {_NOTICE} SELECT 'gov' AS kind, id, 2::BIGINT AS n FROM n WHERE error IS NULL UNION ALL SELECT 'news', conv_id, count(*) FROM conversations WHERE conv_id % 10 > 1 GROUP BY conv_id",
)
def e11_producers(spark, d):
    """Exports by the names that their producers use, each converted by its own builder: claims of notices that may be shown, and of articles."""
    per = lambda claims: claims.groupBy(F.col("bundle").alias("id")).agg(F.count("*").alias("n"))
    builders = {"gov": lambda e: per(adapters.gov_bundle(e)[1].where("destination IN ('graph', 'node_panel_only')")), "news": lambda e: per(adapters.news_bundle(e)[1])}
    found = [adapters.convert(name, builders, export).select(F.lit(kind).alias("kind"), "id", "n") for kind, name, export in (("gov", " Notice", _notices(spark, d)), ("news", "ARTICLE ", _news(spark, d)))]
    return found[0].unionByName(found[1])


@query(
    "e12_approved_payloads",
    """WITH i AS (SELECT conv_id, turn, 'news-' || conv_id AS document, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, text FROM conversations WHERE conv_id % 10 > 1 AND turn % 3 <> 2)
SELECT 't' || conv_id AS title, string_agg('c' || nth || '=point ' || turn, ',' ORDER BY nth) AS claims, string_agg('c' || nth, ',' ORDER BY nth) AS refs, 'P,Q' AS names, 1::INTEGER AS n_edges FROM i GROUP BY conv_id""",
)
def e12_approved_payloads(spark, d):
    """News bundles of which the reviewer left out every third point; both entities hang on all approved points."""
    documents, claims, _ = adapters.news_bundle(_news(spark, d))
    documents, claims = materialize(documents, "news"), materialize(claims, "points")
    items = claims.select(F.col("item_id").alias("id"), (F.regexp_extract("statement", r"([0-9]+)", 1).cast("int") % 3 != 2).alias("enabled"), F.lit(False).alias("blocked"))
    needs = items.select("id", F.col("id").alias("parent")).where("false")
    text = F.lit(None).cast("string")
    entities = claims.select("bundle", "document", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("P").alias("name")), F.struct(F.lit(1).alias("k"), F.lit("Q ").alias("name")))).alias("e"), "pos", "item_id", "ref").select("bundle", "document", (F.col("pos") * 2 + F.col("e.k")).alias("pos"), "item_id", F.col("e.name").alias("name"), F.lit("COMPANY").alias("classification"), text.alias("properties"), F.array("ref").alias("refs"))
    relations = claims.where("pos = 0").select("bundle", "document", "pos", "item_id", F.lit("P").alias("source"), F.lit("Q").alias("target"), F.lit("KNOWS").alias("relation"), F.array("ref").alias("refs"))
    out = adapters.approved_payloads(documents, claims, entities, relations, items, needs)
    shown = F.array_join(F.transform("claims", lambda c: F.concat_ws("=", c["ref_id"], c["claim_text"])), ",")
    refs = F.array_join(F.get("nodes", F.lit(1))["claim_refs"], ",")
    return out.select(F.col("document_title").alias("title"), shown.alias("claims"), refs.alias("refs"), F.array_join("nodes.name", ",").alias("names"), F.size("edges").alias("n_edges"))


@query(
    "e9_change_refs",
    """WITH a AS (SELECT l_partkey AS id, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS id, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
r AS (SELECT l_partkey AS id, string_agg(DISTINCT l_shipmode_, ',' ORDER BY l_shipmode_) AS refs FROM (SELECT l_partkey, l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1)
SELECT coalesce(a.id, b.id) AS node_id, coalesce(refs, '') AS refs, CASE WHEN coalesce(a.id, b.id) % 5 = 0 THEN 'excluded' WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.id = b.id LEFT JOIN r ON r.id = coalesce(a.id, b.id) WHERE a.v IS DISTINCT FROM b.v""",
)
def e9_change_refs(spark, d):
    """Changes with their claims, and those that reviewers left out."""
    lines = table(spark, d, "lineitem").withColumn("path", F.lit("max"))
    snap = lambda f: lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("node_id"), "path").agg(F.max("l_quantity").alias("value"))
    changed = adapters.changes(snap("A"), snap("N"), lines.select(F.col("l_partkey").alias("node_id"), "path", F.col("l_linestatus").alias("claim_ref")))
    left_out = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("node_id"), F.lit("max").alias("path"), F.lit("no").alias("reason"))
    return adapters.comparison(changed, left_out).select("node_id", F.array_join("claim_refs", ",").alias("refs"), "kind")


# From a producer's export over a review to the stored graph.


def _stored_customers(spark, d) -> GraphLedger:
    none = F.lit(None).cast("string")
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"), F.lit("CUSTOMER").alias("classification"), none.alias("description"), none.alias("properties"), F.array().cast("array<bigint>").alias("claim_ids"))
    led = GraphLedger(spark, scratch_path(spark, "bundles"))
    intake.ledger_of(intake.empty_tables(spark) | {"nodes": nodes}, led)
    return led


def _reviewed(spark, d, parts: tuple, graph_parts: tuple, items: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """Approved parts folded into a ledger of customers, and its entities read back with their numbers of claims and relations."""
    led = _stored_customers(spark, d)
    with passing_tables(spark):
        documents, claims = (materialize(p, "bundle") for p in parts)
        needs = items.select("id", F.col("id").alias("parent")).where("false") if needs is None else needs
        intake.fold_into(materialize(adapters.approved_payloads(documents, claims, *graph_parts, items, needs), "payloads"), led)
    n_claims = led.table("evidence").where("kind = 'node'").groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("n_claims"))
    n_edges = led.table("edges").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
    none = F.lit(0).cast("bigint")
    out = led.table("nodes").join(n_claims, "id", "left").join(n_edges, "id", "left").select("name", "classification", "properties", F.coalesce("n_claims", none).alias("n_claims"), F.coalesce("n_edges", none).alias("n_edges"))
    return materialize(out, "reviewed")  # counts of ids are small as files only: joined by what their shuffles measure


@query(
    "e12_news_to_graph",
    """WITH p AS (SELECT conv_id AS c, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos FROM conversations), a AS (SELECT * FROM p WHERE c % 10 > 1 AND turn % 3 <> 2 AND pos < 2),
n AS (SELECT c, pos, coalesce('C' || c_custkey, 'new ' || c) AS name, NULL AS r FROM a LEFT JOIN customer ON c_custkey = c + 1 WHERE pos = 0 UNION ALL SELECT c, pos, 'B' || c % 7, CASE WHEN pos = 1 THEN c END FROM a)
SELECT name, CASE WHEN name LIKE 'C%' THEN 'CUSTOMER' ELSE 'COMPANY' END AS classification, coalesce('{"reports":{"news":{"of":' || max(r) || '}}}', '') AS properties, count(*) AS n_claims, count(*) FILTER (pos = 0) AS n_edges FROM n GROUP BY name""",
)
def e12_news_to_graph(spark, d):
    """Articles with two actors: one that the reviewer ties to a stored customer (or a new one, where there is none), one that many share and that gets a report with the second point; the first point says that they are tied."""
    c = F.col("id")
    actor = lambda name, known, points, at, report: F.struct(name.alias("name"), F.lit("COMPANY").alias("classification"), known.cast("bigint").alias("existing_node_id"), points.alias("points"), at.cast("int").alias("report_point"), report.cast("string").alias("report"))
    a = F.concat(F.lit("new "), c.cast("string"))
    b = F.concat(F.lit("B"), (c % 7).cast("string"))
    none = F.lit(None)
    actors = F.array(actor(a, c + 1, F.array(F.lit(0), F.lit(0)), none, none), actor(b, none, F.array(F.lit(0), F.lit(1)), F.lit(1), F.concat(F.lit('{"of": '), c.cast("string"), F.lit("}"))))
    ties = F.array(F.struct(a.alias("source"), b.alias("target"), F.lit("SUPPLIES").alias("relation"), F.lit(0).alias("point")))
    items = materialize(_news(spark, d).withColumns({"bodyText": F.concat(F.lit("body "), c.cast("string")), "actors": actors, "ties": ties}), "articles")
    documents, claims, _ = adapters.news_bundle(items)
    chosen = claims.select(F.col("item_id").alias("id"), (F.regexp_extract("statement", r"([0-9]+)", 1).cast("int") % 3 != 2).alias("enabled"), F.lit(False).alias("blocked"))
    out = _reviewed(spark, d, (documents, claims), producers.news_graph(items, claims), chosen)
    return out.where("n_claims > 0").withColumn("properties", F.coalesce("properties", F.lit("")))


@query(
    "e16_notices_to_graph",
    """WITH n AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 2 = 0 AS fact FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'O' || c % 20 AS name, 'ORGANIZATION' AS classification, '' AS properties, count(*) AS n_claims, count(*) AS n_edges FROM n WHERE fact GROUP BY 1
UNION ALL SELECT 'G' || o, 'PROGRAM', '{"budget":' || o || '}', 1 + fact::BIGINT, fact::BIGINT FROM n
UNION ALL SELECT 'C' || c, 'CUSTOMER', '{"reports":{"gov":{"strategy":' || max(o) || '}}}', count(*), 0 FROM n GROUP BY c""",
)
def e16_notices_to_graph(spark, d):
    """Notices of few organisers, a program each, and stored customers as subjects; reviewers left out the facts of every second notice, and rejected findings can't be chosen."""
    o, k = F.col("id"), F.col("id").cast("string")
    who = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    named = {
        "local": F.concat(F.lit("local "), k), "snapshots": F.array().cast("array<struct<title: string, text: string>>"), "preparation": F.concat(F.lit('{"strategy":'), k, F.lit("}")),
        "organiser": F.struct(F.concat(F.lit("O"), (F.col("o_custkey") % 20).cast("string")).alias("name"), F.lit(None).cast("bigint").alias("existing_node_id")),
        "program": F.struct(F.concat(F.lit("G"), k).alias("name"), F.lit(None).cast("bigint").alias("existing_node_id"), F.concat(F.lit('{"budget":'), k, F.lit("}")).alias("properties")),
        "subjects": F.array(F.struct(F.lit("chosen").alias("name"), F.col("o_custkey").alias("existing_node_id"))),
    }
    notices = materialize(_notices(spark, d).join(who, "id").withColumns(named), "notices")
    documents, claims, _ = adapters.gov_bundle(notices)
    chosen = claims.select(F.col("item_id").alias("id"), ((F.col("pos") != 0) | (F.col("bundle") % 2 == 0)).alias("enabled"), (F.col("destination") == "rejected").alias("blocked"))
    out = _reviewed(spark, d, (documents, claims), producers.gov_graph(notices, claims), chosen)
    return out.where("n_claims > 0").withColumn("properties", F.coalesce("properties", F.lit("")))


@query(
    "e17_workbooks_to_graph",
    f"""WITH {_BOOK}, g AS (SELECT workbook AS w, now, CASE WHEN was <> 0 THEN trunc((now - was)::DOUBLE / was * 100) END AS growth, workbook % 3 <> 0 AS fact FROM b WHERE error IS NULL),
v AS (SELECT w, coalesce('C' || c_custkey, 'W' || w) AS name, CASE WHEN fact THEN now END AS value, CASE WHEN fact AND w % 5 <> 0 THEN growth END AS growth FROM g LEFT JOIN customer ON c_custkey = w)
SELECT name, value::DOUBLE AS value, value::DOUBLE AS told, growth::DOUBLE AS growth, (value IS NOT NULL)::BIGINT + (growth IS NOT NULL)::BIGINT AS n_claims, 0::BIGINT AS n_edges FROM v
UNION ALL SELECT 'C' || c_custkey, NULL, NULL, NULL, 0, 0 FROM customer WHERE c_custkey NOT IN (SELECT w FROM v)""",
)
def e17_workbooks_to_graph(spark, d):
    """An entity a workbook, stored already where there is a customer of that key. The growth needs the fact; an entity is there even if nothing is approved."""
    documents, claims, _, _ = adapters.workbook_bundle(*_books(spark, d), "S", "C2", "B3", "C3", "Acme", "revenue")
    claims = materialize(claims, "cells")
    w = F.col("bundle")
    subjects = documents.select("bundle", F.concat(F.lit("W"), w.cast("string")).alias("name"), F.lit("COMPANY").alias("classification"), w.cast("bigint").alias("existing_node_id"))
    chosen = claims.select(F.col("item_id").alias("id"), F.when(F.col("ref") == "e-c1", w % 3 != 0).otherwise(w % 5 != 0).alias("enabled"), F.lit(False).alias("blocked"))
    facts = claims.where("ref = 'e-c1'").select("bundle", F.col("item_id").alias("parent"))
    needs = claims.where("ref = 'e-c2'").join(facts, "bundle").select(F.col("item_id").alias("id"), "parent")
    out = _reviewed(spark, d, (documents, claims), producers.workbook_graph(claims, subjects, "revenue"), chosen, needs)
    at = lambda path: F.get_json_object("properties", path).cast("double")
    return out.select("name", at("$.metrics.revenue.value").alias("value"), at("$.reports.excel.facts.revenue.value").alias("told"), at("$.reports.excel.growth.revenue.value").alias("growth"), "n_claims", "n_edges")


# Corpus.


@query("f10_document_canonical", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://h' || page_id || '.example/a/c?k=%7E+x' WHEN 1 THEN 'https://www.h' || page_id || '.example/q~?k=%C3%A9' ELSE 'https://h' || page_id || '.example/a/b' END AS canonical FROM pages".replace("%7E", "~"))
def f10_document_canonical(spark, d):
    n = F.col("page_id").cast("string")
    fetched = F.concat(F.lit("http://h"), n, F.lit(".example/a/b#x"))
    declared = F.when(F.col("page_id") % 3 == 0, "c?k=%7e%20x&utm_source=1").when(F.col("page_id") % 3 == 1, F.concat(F.lit("HTTPS://me@www.H"), n, F.lit(".example:443/q%7E?k=é"))).otherwise("https://elsewhere.example/")
    return table(spark, d, "pages").select("page_id", U.document_canonical(declared, fetched).alias("canonical"))


@query("f15_partners", "WITH p AS (SELECT doc_id, list_concat([lower(substr(text, 1, 30))], list_filter(regexp_split_to_array(lower(text), '\\n\\s*\\n|\\n'), lambda x: trim(x) <> '')) AS c FROM documents) SELECT doc_id, array_to_string(list_filter(['tion', 'ing', 'and'], lambda n: len(list_filter(c, lambda x: contains(x, 'theon') AND contains(x, n))) > 0), ',') AS partners FROM p")
def f15_partners(spark, d):
    names = {n: [n] for n in ("tion", "ing", "and")}
    return table(spark, d, "documents").select("doc_id", F.array_join(T.partners_named(F.substring("text", 1, 30), F.col("text"), ["theon"], names), ",").alias("partners"))


@query("f19_enriched", "SELECT doc_id, sha256(text) AS body_sha256, octet_length(encode(text))::BIGINT AS body_bytes, length(text)::BIGINT AS body_chars FROM documents")
def f19_enriched(spark, d):
    return corpus.enriched(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "body_sha256", "body_bytes", "body_chars")


@query(
    "f22_resume",
    """WITH l AS (SELECT user_id AS k, arg_max(event_type, event_id) AS s, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1)
SELECT c_custkey AS k, coalesce(n, 0)::BIGINT AS retries FROM customer LEFT JOIN l ON k = c_custkey WHERE c_custkey % 10 <> 0 AND coalesce(s, 'click') = 'click'""",
)
def f22_resume(spark, d):
    c = F.col
    candidates = table(spark, d, "customer").select(c("c_custkey").alias("k"))
    log = table(spark, d, "events").select(c("user_id").alias("k"), F.when(c("event_type") == "click", "RETRY_PENDING").otherwise("SELECTED").alias("status"), c("event_id").alias("ordinal"))
    return corpus.resumed(candidates, log, candidates.where("k % 10 = 0"), "k", "ordinal")


@query("f22_seen", "SELECT event_type AS value, min(user_id) AS key FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) WHERE event_type <> 'click' GROUP BY 1")
def f22_seen(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") == "click", "FAILED_HTTP").otherwise("SELECTED").alias("status"), "event_type", F.col("event_id").alias("ordinal"))
    return corpus.selected_index(corpus.latest_records(log, "k", "ordinal"), "event_type", "k")


@query("f25_audit_gate", "SELECT 'a_yes' AS \"check\", count(*) FILTER (lang = 'en') AS found, 1000000::BIGINT AS wanted FROM documents UNION ALL SELECT 'slot_rows', count(*) FILTER (source = 'src1'), -1 FROM documents")
def f25_audit_gate(spark, d):
    c = F.col
    rows = table(spark, d, "documents").select("doc_id", F.lit("no").alias("a"), F.lit("yes").alias("b"), F.when(c("source") == "src1", "s").alias("slot"))
    decisions = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.lit("Yes ").alias("a"))
    summary = corpus.audit_summary(corpus.update_audit(rows, decisions, "doc_id"), ["a", "b"], "slot", "b")
    return corpus.audit_failures(summary, {"a_yes": 1_000_000, "b_yes": 1}, {"slot_rows": -1})


@query("f26_row_rules", "SELECT 'long enough' AS invariant, count(*) FILTER (length(text) < 400 OR text IS NULL) AS found FROM documents UNION ALL SELECT 'slot xx', 0")
def f26_row_rules(spark, d):
    docs = table(spark, d, "documents")
    return corpus.invariants(docs, ["doc_id"], rules={"long enough": F.length("text") >= 400, "has id": F.col("doc_id") >= 0}, slot="lang", slots=["en", "xx"], per_slot=1)


@query("f30_flags", "SELECT c_custkey, c_custkey % 2 = 0 AS yes FROM customer")
def f30_flags(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.flag(F.when(F.col("c_custkey") % 2 == 0, " Yes\t").otherwise("n")).alias("yes"))


# Display.


@query(
    "g7_link_attributes",
    f"{GRAPH_CTE} SELECT e.id, relation = 'LOCATED_IN' AS conflict, relation <> 'SUPPLIES' AS directed, CASE WHEN relation = 'SUPPLIES' THEN 2 ELSE 0 END::INTEGER AS n_evidence FROM edges e",
)
def g7_link_attributes(spark, d):
    claims = F.when(F.col("relation") == "SUPPLIES", F.array(F.lit(1), F.lit(2)))
    members = derived.nodes(spark, d).select("id", F.lit(1).alias("hop"))
    return ranking.classify_links(derived.edges(spark, d).withColumn("claim_ids", claims), members, -1, ("LOCATED_IN",), ("SUPPLIES",)).select("id", "conflict", "directed", "n_evidence")


@query("g16_center", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 3 ELSE 4 END AS center FROM customer")
def g16_center(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", ranking.center_choice(F.when(k % 2 == 0, 1), F.when(k % 3 == 0, 2), F.when(k % 5 == 0, 3), F.lit(4)).alias("center"))


@query("g17_property_lines", "SELECT p_partkey, 'name: ' || p_name || '|ok: yes|size: ' || p_size || '.5' AS lines FROM part")
def g17_property_lines(spark, d):
    size = F.concat(F.col("p_size").cast("string"), F.lit(".500"))
    m = F.create_map(F.lit("size"), size, F.lit("name"), F.col("p_name"), F.lit("ok"), F.lit("true"), F.lit("_k"), F.lit("x"), F.lit("hidden"), F.lit("y"), F.lit("none"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", F.array_join(ranking.property_lines(m, ["hidden"]), "|").alias("lines"))


@query("d14_sections", "SELECT conv_id, turn, role || ':' || CASE WHEN role = 'user' THEN 'risk' ELSE 'general' END AS sections FROM conversations")
def d14_sections(spark, d):
    parts = ranking.sections(F.concat(F.lit("["), F.col("role"), F.lit("] body of "), F.when(F.col("role") == "user", "Danger").otherwise("x")))
    shown = F.transform(parts, lambda p: F.concat(p["title"], F.lit(":"), ranking.section_kind(p["title"], p["body"], {"plan": ["roadmap"], "risk": ["danger", "loss"]})))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(shown, ",").alias("sections"))
