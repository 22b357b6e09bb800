"""Validation and derivation over producers' exports, and approval of reviewed items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import growth_percent, strip
from claimloom.operators.intake import merged_properties
from claimloom.operators.order import fresh, row_numbers
from claimloom.plans.scratch import materialize


def missing_evidence(points: DataFrame, sentences: DataFrame) -> DataFrame:
    """points(item_id, point, evidence array) with no evidence, or with an index that isn't among sentences(item_id, index)."""
    bare = points.where(F.size(F.coalesce("evidence", F.array().cast("array<bigint>"))) == 0).select("item_id", "point", F.lit(None).cast("bigint").alias("index"))
    asked = points.select("item_id", "point", F.explode(F.col("evidence").cast("array<bigint>")).alias("index"))
    return bare.unionByName(asked.join(sentences.select("item_id", F.col("index").cast("bigint").alias("index")).distinct(), ["item_id", "index"], "left_anti").select("item_id", "point", "index"))


def news_errors(items: DataFrame) -> DataFrame:
    """items(id, analysisArticleId, sentences, keyPoints) with an error code: the analysis is of another article, or evidence is missing."""
    known = F.transform(F.coalesce("sentences", F.array().cast("array<struct<index: bigint, text: string>>")), lambda s: s["index"].cast("bigint"))
    lacks = F.exists(F.coalesce("keyPoints", F.array().cast("array<struct<text: string, evidence: array<bigint>>>")), lambda p: (F.size(F.coalesce(p["evidence"], F.array().cast("array<bigint>"))) == 0) | (F.size(F.array_except(p["evidence"].cast("array<bigint>"), known)) > 0))
    return items.withColumn("error", F.when(F.col("keyPoints").isNull(), None).when(~F.col("analysisArticleId").eqNullSafe(F.col("id")), "ANALYSIS_SOURCE_MISMATCH").when(lacks, "MISSING_EVIDENCE_REFERENCE"))


def sentence_texts(points: DataFrame, sentences: DataFrame) -> DataFrame:
    """(item_id, point, index, text): the sentence behind each piece of evidence."""
    asked = points.select("item_id", "point", F.explode(F.col("evidence").cast("array<bigint>")).alias("index"))
    return asked.join(sentences.select("item_id", F.col("index").cast("bigint").alias("index"), "text"), ["item_id", "index"], "left")


def identifiers_ok(*ids: Column) -> Column:
    """Whether all are positive."""
    out = F.lit(True)
    for c in ids:
        out = out & F.coalesce(c > 0, F.lit(False))
    return out


def notice_body(snapshots: Column, local: Column, preparation: Column) -> tuple[Column, Column]:
    """(text, error): the first snapshot's text, else the local file's; without either and without preparation an error."""
    text = F.coalesce(F.get(snapshots, 0)["text"], local)
    return text, F.when(text.isNull() & preparation.isNull(), "MISSING_NOTICE_BODY")


def cell_index(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, address, value) from cells(workbook, sheet, address, value, ordinal): the last of each address; sheet defaults to Sheet1."""
    sheet = F.coalesce("sheet", F.lit("Sheet1"))
    return cells.groupBy("workbook", sheet.alias("sheet"), "address").agg(F.max_by("value", "ordinal").alias("value"))


def workbook_cells(workbooks: DataFrame) -> DataFrame:
    """cells of workbooks(workbook, sheets array<struct<name, regions, tables>>), regions before tables, each with previewRows of cells(address, value)."""
    sheets = workbooks.select("workbook", F.posexplode("sheets").alias("s", "sheet"))
    blocks = sheets.select("workbook", "s", F.col("sheet.name").alias("sheet"), F.posexplode(F.concat(F.coalesce("sheet.regions", F.array().cast(_BLOCKS)), F.coalesce("sheet.tables", F.array().cast(_BLOCKS)))).alias("b", "block"))
    rows = blocks.select("workbook", "s", "sheet", "b", F.posexplode("block.previewRows").alias("r", "row"))
    return rows.select("workbook", "sheet", "s", "b", "r", F.posexplode("row").alias("c", "cell")).select("workbook", "sheet", "cell.address", "cell.value", F.struct("s", "b", "r", "c").alias("ordinal"))


_BLOCKS = "array<struct<previewRows: array<array<struct<address: string, value: string>>>>>"


def changes(before: DataFrame, after: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(node_id, path, before, after) of values that differ between two snapshots (node_id, path, value), unique in (node_id, path); with refs(node_id, path, claim_ref) also their sorted claim_refs."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    out = a.join(b, ["node_id", "path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    if refs is None:
        return out
    shown = refs.groupBy("node_id", "path").agg(F.array_sort(F.collect_set("claim_ref")).alias("claim_refs"))
    return out.join(shown, ["node_id", "path"], "left").withColumn("claim_refs", F.coalesce("claim_refs", F.array().cast("array<string>")))


def comparison(changed: DataFrame, excluded: DataFrame) -> DataFrame:
    """changes with `kind`: added, removed or changed, or excluded where (node_id, path) is among excluded(node_id, path, reason); and the reason."""
    kind = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return changed.join(excluded.groupBy("node_id", "path").agg(F.min("reason").alias("reason")), ["node_id", "path"], "left").withColumn("kind", kind)


def replay_fingerprint(df: DataFrame, ignore: list[str]) -> Column:
    """SHA-256 of a row without the columns that change from export to export."""
    return F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ignore])), 256)


def drop_replays(df: DataFrame, ignore: list[str]) -> DataFrame:
    """One row per content."""
    return df.withColumn("fingerprint", replay_fingerprint(df, ignore)).dropDuplicates(["fingerprint"])


#: What becomes of a statement by its modality.
DESTINATIONS = {"FACT": "graph", "DERIVED_FACT": "node_panel_only", "PLAN": "node_panel_only", "CONDITIONAL_REQUIREMENT": "node_panel_only", "RECOMMENDATION": "external_analysis_only"}


def route(statements: DataFrame) -> DataFrame:
    """statements(modality, ...) with destination and reason (columns of these names are replaced); an unknown or null modality is rejected with a reason."""
    table = F.create_map(*[F.lit(x) for kv in DESTINATIONS.items() for x in kv])
    to = table[F.col("modality")]
    return statements.withColumn("destination", F.coalesce(to, F.lit("rejected"))).withColumn("reason", F.when(to.isNull(), F.concat(F.lit("UNKNOWN_MODALITY:"), F.coalesce("modality", F.lit("")))))


#: Producers by the names that their exports use.
PRODUCERS: dict[str, str] = {"news": "news", "article": "news", "gov": "gov", "notice": "gov", "excel": "excel", "workbook": "excel"}


def producer(name: str) -> str:
    found = PRODUCERS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown producer: {name}")
    return found


def producer_of(source: Column) -> Column:
    """The producer that a source's name hints at, or `other`."""
    low = F.lower(source)
    return F.when(low.contains("news"), "news").when(low.contains("gov"), "gov").when(low.contains("excel"), "excel").otherwise("other")


def effective_items(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Ids of items(id, enabled, blocked) that are on: enabled, not blocked, and all they need, needs(id, parent), is on.

    Starts with the items that need nothing. A round counts, for the items that need one that the
    round before turned on, how many of their needs are met, and turns on those that lack none; it
    carries the newly turned on and the partly met only. Rounds are as many as the longest chain.
    Items that need themselves, or each other in a ring, stay off, and so does what needs a parent
    that is no item. Repeated needs count once.
    """
    wanted = materialize(items.where("enabled AND NOT blocked").select("id").distinct(), "effective-wanted")
    links = materialize(needs.select("id", "parent").distinct().join(wanted, "id", "left_semi"), "effective-needs")
    open_needs = materialize(links.groupBy("id").agg(F.count("*").alias("n")), "effective-counts")
    new = materialize(wanted.join(open_needs, "id", "left_anti"), "effective")
    on, partly = new, open_needs.where("false").select("id", F.col("n").alias("met"))
    while not new.isEmpty():
        met = links.join(new.withColumnRenamed("id", "parent"), "parent", "left_semi").groupBy("id").agg(F.count("*").alias("met"))
        counted = met.unionByName(partly).groupBy("id").agg(F.sum("met").alias("met")).join(open_needs, "id")
        counted = materialize(counted, "effective-counted")
        new, partly = counted.where("met = n").select("id"), counted.where("met < n").select("id", "met")
        on = on.unionByName(new)
    return on


def suppressed_items(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Ids that are enabled and not blocked, but off for something they need."""
    return items.where("enabled AND NOT blocked").select("id").join(effective_items(items, needs), "id", "left_anti")


def approved_claims(claims: DataFrame, items: DataFrame, needs: DataFrame, by: list[str] = ["bundle"]) -> DataFrame:  # noqa: B006
    """claims(bundle, pos, item_id, quote) of items that are on, with dense refs c0, c1, ... per bundle (or per other columns). Nothing enabled gives no rows."""
    live = claims.join(effective_items(items, needs).withColumnRenamed("id", "item_id"), "item_id", "left_semi")
    nth = fresh(live, "nth")
    return row_numbers(live, by, ["pos"], nth).withColumn("ref", F.concat(F.lit("c"), (F.col(nth) - 1).cast("string"))).drop(nth)


def approved_payloads(documents: DataFrame, claims: DataFrame, entities: DataFrame, relations: DataFrame, items: DataFrame, needs: DataFrame) -> DataFrame:
    """What reviewers approved of bundles, as payloads for the write path: one per document with an approved item, in order of (bundle, document).

    documents(bundle, document, source_project, title, content, uri, always): with `always`, a
    payload even if nothing of it is approved. claims(bundle, document, pos, item_id, ref, quote,
    statement), entities(bundle, document, pos, item_id, name, classification, properties,
    refs array), relations(bundle, document, pos, item_id, source, target, relation, refs array).
    Item ids are unique over bundles. Claims get dense references in order of pos; entities of one
    document and name become one, with all their references, their properties merged as stored
    ones are (`intake.merged_properties`), and the first existing_node_id (a column of entities
    that may be lacking) of those approved. An entity without an item is there whatever is
    approved, if its document is. A relation counts if both its ends are entities of the document
    that are there. References to claims that weren't approved go.
    """
    at = ["bundle", "document"]
    on = materialize(effective_items(items, needs).withColumnRenamed("id", "item_id"), "approved")
    # What is numbered in a document ends in one row of it, so a task may as well sort it.
    nth = lambda *order: F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    kept = claims.join(on, "item_id", "left_semi").withColumn("nth", nth("pos")).withColumn("new_ref", F.concat(F.lit("c"), (F.col("nth") - 1).cast("string")))
    kept = materialize(kept, "approved-claims")
    known = kept.select(*at, F.col("ref").alias("old"), "new_ref", F.col("nth").alias("ref_nth"))
    found = lambda rows, key: rows.select(*at, *key, F.explode("refs").alias("old")).join(known, [*at, "old"]).groupBy(*at, *key).agg(F.transform(F.array_sort(F.collect_set(F.struct("ref_nth", "new_ref"))), lambda x: x["new_ref"]).alias("claim_refs"))
    none = F.array().cast("array<string>")
    if "existing_node_id" not in entities.columns:
        entities = entities.withColumn("existing_node_id", F.lit(None).cast("bigint"))
    live = entities.join(on, "item_id", "left_semi").unionByName(entities.where("item_id IS NULL").join(documents.select(*at).distinct(), at, "left_semi")).withColumn("name", strip(F.col("name")))
    live = materialize(live.select(*at, "pos", "name", "classification", "properties", "existing_node_id", "refs"), "approved-mentions")
    one = live.groupBy(*at, "name").agg(F.min("pos").alias("pos"), F.min_by("classification", "pos").alias("classification"), F.min_by("existing_node_id", F.when(F.col("existing_node_id").isNotNull(), F.col("pos"))).alias("existing_node_id"))
    said = merged_properties(live.select(F.struct(*at, "name").alias("node_id"), "properties", F.lit(0).alias("seq"), "pos", F.lit(True).alias("creates")))
    one = one.join(said.select("node_id.*", "properties"), [*at, "name"], "left")
    one = one.withColumn("nth", nth("pos", "name")).withColumn("ref_id", F.concat(F.lit("n"), (F.col("nth") - 1).cast("string")))
    one = materialize(one.join(found(live, ["name"]), [*at, "name"], "left"), "approved-entities")
    edges = relations.join(on, "item_id", "left_semi")
    edges = edges.join(found(edges, ["pos"]), [*at, "pos"], "left")
    for end in ("source", "target"):
        edges = edges.withColumn(end, strip(F.col(end))).join(one.select(*at, F.col("name").alias(end), F.col("ref_id").alias(f"{end}_ref")), [*at, end])
    text = F.lit(None).cast("string")
    nodes_of = one.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("nth", F.struct("ref_id", "name", "classification", text.alias("description"), "properties", "existing_node_id", text.alias("claim_ref"), F.coalesce("claim_refs", none).alias("claim_refs")).alias("n")))).alias("n")).select(*at, F.col("n.n").alias("nodes"))
    edges_of = edges.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("source_ref", "target_ref", F.col("source").alias("source_name"), F.col("target").alias("target_name"), "relation", text.alias("claim_ref"), F.coalesce("claim_refs", none).alias("claim_refs")).alias("e")))).alias("e")).select(*at, F.col("e.e").alias("edges"))
    offset = F.lit(None).cast("int")
    claims_of = kept.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(F.col("new_ref").alias("ref_id"), "quote", F.col("statement").alias("claim_text"), offset.alias("start_offset"), offset.alias("end_offset")).alias("c")))).alias("c")).select(*at, F.col("c.c").alias("claims"))
    out = documents.join(nodes_of, at, "left").join(edges_of, at, "left").join(claims_of, at, "left").where("always OR nodes IS NOT NULL OR edges IS NOT NULL OR claims IS NOT NULL")
    # Numbering looks at its rows twice: written before, they are joined once.
    numbered = row_numbers(materialize(out, "approved-payloads"), [], at, "seq")
    return numbered.select("seq", "source_project", F.col("title").alias("document_title"), F.col("content").alias("document_content"), F.col("uri").alias("document_uri"), "nodes", "edges", "claims")


def news_bundle(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, rejected) of analysed articles(id, title, bodyText, url, analysisArticleId, sentences, keyPoints).

    A claim per key point: its text as statement, its first evidence sentence as quote. Articles
    with an error of news_errors are rejected with it.
    """
    checked = news_errors(items)
    good = checked.where("error IS NULL")
    name = F.concat(F.lit("news-"), F.col("id").cast("string"))
    documents = good.select(F.col("id").alias("bundle"), name.alias("document"), F.lit("news").alias("source_project"), "title", F.col("bodyText").alias("content"), F.col("url").alias("uri"), F.lit(False).alias("always"))
    points = good.select(F.col("id").alias("bundle"), name.alias("document"), F.posexplode("keyPoints").alias("pos", "p"), "sentences")
    quote = F.get(F.filter("sentences", lambda s: s["index"] == F.get(F.col("p.evidence"), 0)), 0)["text"]
    number = F.col("pos").cast("string")
    claims = points.select("bundle", "document", "pos", F.concat_ws(":", "document", number).alias("item_id"), F.concat(F.lit("n-c"), (F.col("pos") + 1).cast("string")).alias("ref"), quote.alias("quote"), F.col("p.text").alias("statement"))
    return documents, claims, checked.where("error IS NOT NULL").select("id", "error")


def gov_bundle(notices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, rejected) of notices(id, detectionId, documentId, versionId, title, snapshots, local, preparation, findings array<struct<statement, quote, modality>>).

    The notice's body and the producer's analysis are two documents: findings that recommend
    belong to the analysis, all others to the body, so relations can only rest on the body.
    Each claim has its destination by modality. Bad identifiers and missing bodies are rejected.
    """
    body, missing = notice_body(F.col("snapshots"), F.col("local"), F.col("preparation"))
    error = F.when(~identifiers_ok(F.col("detectionId"), F.col("documentId"), F.col("versionId")), "MISSING_GOV_IDENTIFIER").otherwise(missing)
    checked = notices.withColumn("error", error).withColumn("body", body)
    good = checked.where("error IS NULL")
    shown = F.coalesce(F.get(F.col("snapshots"), 0)["title"], F.col("title"))
    kinds = F.explode(F.array(F.struct(F.lit("gov-body").alias("document"), shown.alias("title"), F.col("body").alias("content")), F.struct(F.lit("gov-report").alias("document"), F.concat(F.lit("Analysis of "), shown).alias("title"), F.coalesce("preparation", F.lit("{}")).alias("content"))))
    documents = good.select(F.col("id").alias("bundle"), kinds.alias("d")).select("bundle", "d.document", F.lit("gov").alias("source_project"), "d.title", "d.content", F.lit(None).cast("string").alias("uri"), F.lit(False).alias("always"))
    found = route(good.select(F.col("id").alias("bundle"), F.posexplode("findings").alias("pos", "f")).select("bundle", "pos", "f.*"))
    number = (F.col("pos") + 1).cast("string")
    claims = found.select("bundle", F.when(F.col("modality") == "RECOMMENDATION", "gov-report").otherwise("gov-body").alias("document"), "pos", F.concat_ws(":", F.lit("gov"), F.col("bundle").cast("string"), number).alias("item_id"), F.concat(F.lit("g-c"), number).alias("ref"), "quote", "statement", "modality", "destination")
    return documents, claims, checked.where("error IS NOT NULL").select("id", "error")


def workbook_bundle(workbooks: DataFrame, cells: DataFrame, columns: DataFrame, sheet: str, period: str, before: str, after: str, node: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, claims, changes, rejected) of workbooks(workbook, schema_version): a fact on the cell `after`, a derived fact on its growth over `before`, a property change, and no relations.

    cells: cell_index with numbers. Workbooks that period_gate refuses are rejected with its error.
    Growth is cut to an integer, null where there is no base.
    """
    checked = period_gate(workbooks, cells, columns, sheet, period)
    value = lambda address, name: cells.where((F.col("sheet") == sheet) & (F.col("address") == address)).select("workbook", F.col("value").cast("double").alias(name))
    good = checked.where("error IS NULL").join(value(before, "was"), "workbook", "left").join(value(after, "now"), "workbook", "left")
    growth = growth_percent(F.col("now"), F.col("was")).cast("int")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    documents = good.select(F.col("workbook").alias("bundle"), F.lit("excel-snapshot").alias("document"), F.lit("excel").alias("source_project"), F.col("workbook").cast("string").alias("title"), F.concat(F.lit(f"{sheet}: {after}="), shown(F.col("now")), F.lit(f", {before}="), shown(F.col("was"))).alias("content"), F.lit(None).cast("string").alias("uri"), F.lit(True).alias("always"))
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("e-c1").alias("ref"), F.lit("FACT").alias("modality"), F.concat(F.lit(f"{path} is "), shown(F.col("now"))).alias("statement"), F.lit(f"{sheet}!{after}").alias("quote"), F.col("now").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("e-c2").alias("ref"), F.lit("DERIVED_FACT").alias("modality"), F.concat(F.lit(f"{path} grew by "), shown(growth), F.lit("%")).alias("statement"), F.lit(f"{sheet}!{before},{after}").alias("quote"), growth.cast("double").alias("value")),
    )
    claims = good.withColumn("growth", growth).select(F.col("workbook").alias("bundle"), F.lit("excel-snapshot").alias("document"), "now", "growth", F.explode(rows).alias("r")).where("r.pos = 0 OR growth IS NOT NULL")
    claims = claims.select("bundle", "document", "r.pos", F.concat_ws(":", F.lit("excel"), F.col("bundle").cast("string"), F.col("r.pos").cast("string")).alias("item_id"), "r.ref", "r.quote", "r.statement", "r.modality", "r.value", F.col("now").alias("fact"))
    key = lambda c: good.select(F.lit(node).alias("node"), F.col("workbook").alias("node_id"), F.lit(path).alias("path"), F.col(c).alias("value")).drop("node")
    changed = changes(key("was"), key("now"), good.select(F.col("workbook").alias("node_id"), F.lit(path).alias("path"), F.lit("e-c1").alias("claim_ref"))).withColumn("node", F.lit(node))
    return documents, claims, changed, checked.where("error IS NOT NULL").select("workbook", "error")


def valid_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """edges(source, target, ...) with `reason`: null if both ends are among selected(ref, name), by reference or by name in any case."""
    keys = selected.select(F.explode(F.array(F.col("ref"), F.lower(strip(F.col("name"))))).alias("key")).where("key IS NOT NULL").distinct()
    out, hits = edges, {}
    for end in ("source", "target"):
        as_ref, as_name, by_ref, by_name = (fresh(out, x) for x in (f"{end}_as_ref", f"{end}_as_name", f"{end}_by_ref", f"{end}_by_name"))
        refs, names = keys.select(F.col("key").alias(as_ref), F.lit(True).alias(by_ref)), keys.select(F.col("key").alias(as_name), F.lit(True).alias(by_name))
        out = out.withColumns({as_ref: F.col(end), as_name: F.lower(strip(F.col(end)))}).join(refs, as_ref, "left").join(names, as_name, "left").drop(as_ref, as_name)
        hits[end] = (by_ref, by_name)
    ok = lambda end: F.coalesce(*hits[end], F.lit(False))
    reason = F.when(~ok("source") & ~ok("target"), "BOTH_ENDS_MISSING").when(~ok("source"), "SOURCE_MISSING").when(~ok("target"), "TARGET_MISSING")
    return out.withColumn("reason", reason).drop(*hits["source"], *hits["target"])


def convert(kind: str, builders: dict[str, Callable[[DataFrame], DataFrame]], export: DataFrame) -> DataFrame:
    """The builder of the kind's producer on an export; ValueError for an unknown one."""
    return builders[producer(kind)](export)


def period_gate(workbooks: DataFrame, cells: DataFrame, columns: DataFrame, sheet: str, address: str) -> DataFrame:
    """workbooks(workbook, schema_version) with `error`: another schema version, or a period found neither in a cell nor in the labels of its column.

    cells: cell_index. columns(workbook, sheet, column, label): header labels. A null schema
    version is another one.
    """
    cell, head = fresh(workbooks, "in_cell"), fresh(workbooks, "in_head")
    letter = "".join(c for c in address if c.isalpha())
    in_cell = cells.where((F.col("sheet") == sheet) & (F.col("address") == address) & F.col("value").isNotNull()).select("workbook").distinct().withColumn(cell, F.lit(True))
    in_head = columns.where((F.col("sheet") == sheet) & (F.col("column") == letter) & F.col("label").isNotNull()).select("workbook").distinct().withColumn(head, F.lit(True))
    out = workbooks.join(in_cell, "workbook", "left").join(in_head, "workbook", "left")
    return out.withColumn("error", F.when(~F.col("schema_version").eqNullSafe("1.0"), "UNSUPPORTED_SCHEMA").when(F.coalesce(cell, head).isNull(), "MISSING_PERIOD_REFERENCE")).drop(cell, head)


def rename_entities(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """edges(source, target, ...) with names changed by renames(old, new); of several new names the least counts."""
    out, new = edges, fresh(edges, "new")
    for end in ("source", "target"):
        r = renames.groupBy(F.col("old").alias(end)).agg(F.min("new").alias(new))
        out = out.join(r, end, "left").withColumn(end, F.coalesce(new, end)).drop(new)
    return out
