"""Extraction responses as a stream: ground them, and fold them into a ledger batch by batch; retries as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import date
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimloom.functions.text import strip
from claimloom.operators import grounding, intake
from claimloom.operators.stored import GraphLedger
from claimloom.plans.scratch import materialize

RESPONSES = "doc_id bigint, title string, content string, raw_response string"


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses that land in a folder as JSON lines."""
    return spark.readStream.schema(RESPONSES).json(path)


def decoded(batch: DataFrame, most_content: int | None = None) -> DataFrame:
    """Responses with `extracted` and `reason`, null for those that are fit for grounding. Written, since decoding takes longer than all that follows from it."""
    long = F.lit(False) if most_content is None else grounding.too_long(F.col("content"), most_content)
    rows = grounding.decode_responses(batch)
    reason = F.when(long, f"content longer than {most_content}").when(F.col("extracted").isNull(), "response is no JSON")
    return materialize(rows.withColumn("reason", reason), "decoded")


class Grounded(Mapping):
    """claims, entities and edges of decoded responses, after all grounding rules, the responses that they are of (decoded), and rejected(doc_id, reason). Each is worked out once, when it is asked for."""

    NAMES = ("claims", "entities", "edges", "decoded", "rejected")

    def __init__(self, rows: DataFrame, known: DataFrame, most_entities: int | None = None):
        self.rows, self.known, self.most_entities = rows, known, most_entities

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    @property
    def rejected(self) -> DataFrame:
        return self.rows.where("reason IS NOT NULL").select("doc_id", "reason")

    @property
    def decoded(self) -> DataFrame:
        return self.rows.where("reason IS NULL")

    @cached_property
    def claims(self) -> DataFrame:
        return materialize(grounding.claims_of(self.decoded), "extracted-claims")

    @cached_property
    def entities(self) -> DataFrame:
        """A document without claims supports all its entities."""
        named = self.decoded.select("doc_id", F.posexplode("extracted.nodes").alias("pos", "n")).select("doc_id", "pos", "n.name")
        return materialize(grounding.ground_entities(named, self.claims, self.most_entities), "grounded-entities")

    @cached_property
    def edges(self) -> DataFrame:
        told = self.decoded.select("doc_id", F.posexplode("extracted.edges").alias("pos", "e")).select("doc_id", "pos", "e.*")
        admitted = materialize(grounding.admit_edges(told, self.entities, self.known), "admitted-edges")
        return materialize(grounding.attribute_edges(admitted, self.claims), "grounded-edges")


def grounded(batch: DataFrame, known: DataFrame, most_content: int | None = None, most_entities: int | None = None) -> Grounded:
    """What a batch of responses says, after all grounding rules; rejected are contents longer than most_content (if given), and responses that are no JSON."""
    return Grounded(decoded(batch, most_content), known, most_entities)


def payloads(parts: Mapping[str, DataFrame], source_project: str = "agent-ingestion") -> DataFrame:
    """What grounded returns, as payloads for the write path, one per document, seq its doc_id.

    An entity carries its supporting claims; an edge its ends' references, where they are
    entities of the document, and its claim.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    decoded, claims, entities, edges = (parts[k] for k in ("decoded", "claims", "entities", "edges"))
    as_list = lambda rows, item, name: rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda p: p["x"]).alias(name))
    c = as_list(claims, F.struct(F.col("ref").alias("ref_id"), "quote", "claim_text", F.col("start").alias("start_offset"), F.col("end").alias("end_offset")), "claims")
    told = decoded.select("doc_id", F.posexplode("extracted.nodes").alias("pos", "n")).select("doc_id", "pos", "n.classification", "n.description", "n.properties")
    n = as_list(entities.join(told, ["doc_id", "pos"]), F.struct("ref_id", "name", "classification", "description", "properties", number.alias("existing_node_id"), F.get("claim_refs", F.lit(0)).alias("claim_ref"), "claim_refs"), "nodes")
    ends = entities.groupBy("doc_id", F.lower("name").alias("low")).agg(F.max_by("ref_id", "pos").alias("ref"))
    for end in ("source", "target"):
        edges = edges.withColumn("low", F.lower(strip(F.col(f"{end}_name")))).join(ends.withColumnRenamed("ref", f"{end}_ref"), ["doc_id", "low"], "left").drop("low")
    e = as_list(edges, F.struct("source_ref", "target_ref", strip(F.col("source_name")).alias("source_name"), strip(F.col("target_name")).alias("target_name"), "relation", "claim_ref", F.array_compact(F.array("claim_ref")).alias("claim_refs")), "edges")
    out = decoded.select("doc_id", "title", "content").join(n, "doc_id", "left").join(e, "doc_id", "left").join(c, "doc_id", "left")
    return out.select(F.col("doc_id").cast("bigint").alias("seq"), F.lit(source_project).alias("source_project"), F.col("title").alias("document_title"), F.col("content").alias("document_content"), text.alias("document_uri"), "nodes", "edges", "claims")


def run(stream: DataFrame, known: Callable[[], DataFrame], commit: Callable[[Mapping[str, DataFrame], int], None], checkpoint: str) -> StreamingQuery:
    """Ground each batch of new responses (one per doc_id in it) and hand the tables and the batch's number to commit, which skips numbers that it has."""

    def one(batch: DataFrame, number: int) -> None:
        commit(grounded(batch.dropDuplicates(["doc_id"]), known()), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def end_names(rows: DataFrame) -> DataFrame:
    """(name) of all ends of relations in decoded responses."""
    edges = rows.where("reason IS NULL").select(F.explode("extracted.edges").alias("e"))
    return edges.select(F.explode(F.array("e.source_name", "e.target_name")).alias("name")).where("name IS NOT NULL").distinct()


def run_into(stream: DataFrame, ledger: GraphLedger, source: str, checkpoint: str, most_content: int | None = None, most_entities: int | None = None) -> StreamingQuery:
    """Ground each batch, and fold it into a graph's ledger in one commit, once for each batch number of the source, also after a restart. Of the ledger only what the batch names is read."""

    def one(batch: DataFrame, number: int) -> None:
        if ledger.has(source, number):
            return
        rows = decoded(batch.dropDuplicates(["doc_id"]), most_content)
        known = materialize(ledger.known_names(materialize(end_names(rows), "end-names")), "known-names")
        parts = Grounded(rows, known, most_entities)
        intake.fold_into(materialize(payloads(parts), "payloads"), ledger, source, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_once(attempts: DataFrame, hours: int | None = None) -> DataFrame:
    """(key, outcome) of attempts(key, status): RETRY for a key's first RETRY_PENDING, FAILED_HTTP for its second, else the status.

    Only keys with a RETRY_PENDING have state. It goes, if hours are given, when that long has
    passed without an attempt; a later attempt starts anew.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tries = state.get[0] if state.exists else 0
        out = []
        for part in parts:
            for status in part["status"]:
                if status == "RETRY_PENDING":
                    tries += 1
                    out.append("RETRY" if tries == 1 else "FAILED_HTTP")
                else:
                    out.append(status)
        if tries:
            state.update((tries,))
            if hours is not None:
                state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"key": [key[0]] * len(out), "outcome": out})

    timeout = GroupStateTimeout.NoTimeout if hours is None else GroupStateTimeout.ProcessingTimeTimeout
    return attempts.groupBy("key").applyInPandasWithState(step, "key string, outcome string", "tries int", "Append", timeout)


def fixed_windows(events: DataFrame, ts: str, days: int, start: str, late: str) -> DataFrame:
    """Counts of a stream per tumbling window of `days` days from start (a date); a window is closed when `late` has passed."""
    offset = (date.fromisoformat(start) - date(1970, 1, 1)).days % days
    window = F.window(F.col(ts), f"{days} days", f"{days} days", f"{offset} days")
    return events.withWatermark(ts, late).groupBy(window).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has arrived, and return its result: that of the last batch in complete mode, of all batches else."""

    def one(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"  # a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")
