"""A queue of follow-up work as keyed state: what waits once, in order, up to a limit, with retries at the tail.

Events (queue string, seq bigint, kind string, id bigint), of which a queue sees its own in order of
seq within a batch, batch after batch:

- `ask`: the id is ACCEPTED at the tail; DUPLICATE if it waits already; FULL if as many wait as the
  limit allows. What is being worked on doesn't wait, so it may be asked for again.
- `take`: the id at the head is TAKEN (the event's own id doesn't matter), or the queue is EMPTY.
- `done`: the id is DONE; UNKNOWN if nobody works on it.
- `failed`: the id is RETRIED at the tail, whatever the limit, until it has been taken as often as
  `tries` allows, then DROPPED. If it has been asked for meanwhile, that place keeps the lesser of
  both counts and the failure is a DUPLICATE.

Other kinds, and events without a queue, say nothing; an `ask`, `done` or `failed` without an id is
UNKNOWN. Every event gets one outcome, so replays of a checkpointed stream give the same rows. Equal
seqs are taken by kind, then id. An empty stream gives nothing.

A queue is serial: its events of one batch are sorted in one task. Queues that are too large are
dealt into shards by id (`dealt`), which keeps ids single; the limit is a shard's then. Places are
counted up, so an event costs a constant number of state reads however many wait. Entries of
neighbouring ids, and of neighbouring places, share a row of state: a batch reads and writes each
row once, since every call to the store costs more than an event does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "queue string, seq bigint, kind string, id bigint"
OUTCOME = "queue string, seq bigint, kind string, id bigint, outcome string, taken int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """State with maps and timers needs this store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def asks(affected: DataFrame, queue: str, seq: int, most: int | None = None) -> DataFrame:
    """Events that ask for the least ids of affected(id), at most `most` of them (without it, all): what a commit enqueues."""
    ids = affected.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    ids = ids if most is None else ids.orderBy("id").limit(most)
    return ids.select(F.lit(queue).alias("queue"), F.lit(seq).cast("bigint").alias("seq"), F.lit("ask").alias("kind"), "id")


def dealt(events: DataFrame, shards: int) -> DataFrame:
    """Events with queues cut into shards by id. Takes name no id: each is dealt by its seq."""
    by = F.when(F.col("kind") == "take", F.col("seq")).otherwise(F.coalesce("id", F.lit(0)))
    return events.withColumn("queue", F.concat_ws("/", "queue", F.pmod(F.xxhash64(by), F.lit(shards)).cast("string")))


#: Neighbouring numbers whose entries share a row of state.
BLOCK = 64


class _Map:
    """Entries by number in a map state of blocks (as JSON), of which a batch reads each once and writes each changed one once. empty: there is nothing to read."""

    def __init__(self, state, empty: bool):
        self.state, self.empty, self.now, self.was = state, empty, {}, {}

    def _block(self, key: int) -> dict[str, list]:
        at = key // BLOCK
        if at not in self.now:
            held = None if self.empty else self.state.getValue((at,))
            self.was[at] = None if held is None else held[0]
            self.now[at] = {} if held is None else json.loads(held[0])
        return self.now[at]

    def get(self, key: int) -> list | None:
        return self._block(key).get(str(key))

    def put(self, key: int, value: tuple | None) -> None:
        if value is None:
            self._block(key).pop(str(key), None)
        else:
            self._block(key)[str(key)] = list(value)

    def flush(self) -> None:
        for at, block in self.now.items():
            text = json.dumps(block, sort_keys=True) if block else None
            if text is None and self.was[at] is not None:
                self.state.removeKey((at,))
            elif text != self.was[at]:
                self.state.updateValue((at,), (text,))


class _Queue(StatefulProcessor):
    """waiting: id -> (place, taken). places: place -> (id). running: id -> (taken, since). Each in blocks of numbers."""

    def __init__(self, limit: int | None, tries: int, lease: int | None):
        self.limit, self.tries, self.lease = limit, tries, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "head bigint, tail bigint, n bigint")
        self.states = [handle.getMapState(name, "block bigint", "entries string") for name in ("waiting", "places", "running")]

    def _open(self) -> None:
        ends = self.ends.get()
        self.waiting, self.places, self.running = (_Map(s, ends is None) for s in self.states)
        self.head, self.tail, self.n = (0, 0, 0) if ends is None else (int(x) for x in ends)

    def _close(self) -> None:
        for m in (self.waiting, self.places, self.running):
            m.flush()
        self.ends.update((self.head, self.tail, self.n))

    def _enter(self, i: int, taken: int) -> None:
        self.waiting.put(i, (self.tail, taken))
        self.places.put(self.tail, (i,))
        self.tail, self.n = self.tail + 1, self.n + 1

    def _ask(self, i: int) -> tuple[str, int]:
        if self.waiting.get(i) is not None:
            return "DUPLICATE", self.waiting.get(i)[1]
        if self.limit is not None and self.n >= self.limit:
            return "FULL", 0
        self._enter(i, 0)
        return "ACCEPTED", 0

    def _take(self, now: int) -> tuple[str, int | None, int]:
        if not self.n:
            return "EMPTY", None, 0
        i = int(self.places.get(self.head)[0])
        taken = int(self.waiting.get(i)[1]) + 1
        self.places.put(self.head, None)
        self.waiting.put(i, None)
        self.head, self.n = self.head + 1, self.n - 1
        self.running.put(i, (taken, now))
        return "TAKEN", i, taken

    def _fail(self, i: int) -> tuple[str, int]:
        held = self.running.get(i)
        if held is None:
            return "UNKNOWN", 0
        taken = int(held[0])
        self.running.put(i, None)
        again = self.waiting.get(i)
        if again is not None:
            self.waiting.put(i, (again[0], min(int(again[1]), taken)))
            return "DUPLICATE", taken
        if taken >= self.tries:
            return "DROPPED", taken
        self._enter(i, taken)
        return "RETRIED", taken

    def _done(self, i: int) -> tuple[str, int]:
        held = self.running.get(i)
        self.running.put(i, None)
        return ("UNKNOWN", 0) if held is None else ("DONE", int(held[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = [(int(seq), kind, None if pd.isna(i) else int(i)) for part in rows for seq, kind, i in zip(part["seq"], part["kind"], part["id"], strict=True)]
        batch.sort(key=lambda e: (*e[:2], e[2] is None, e[2] or 0))
        now = 0 if self.lease is None else timerValues.getCurrentProcessingTimeInMs()
        self._open()
        out = []
        for seq, kind, i in batch:
            if kind == "take":
                outcome, i, taken = self._take(now)
                if i is not None and self.lease is not None:
                    self.handle.registerTimer(now + self.lease)
            elif i is None:
                outcome, taken = "UNKNOWN", 0
            else:
                outcome, taken = {"ask": self._ask, "done": self._done, "failed": self._fail}[kind](i)
            out.append((key[0], seq, kind, i, outcome, int(taken)))
        self._close()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What has been worked on for longer than the lease fails, in order of start and id."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.lease
        running = [(int(v[1]), int(i)) for _, block in self.states[2].iterator() for i, v in json.loads(block[0]).items()]
        late = sorted((since, i) for since, i in running if since <= until)
        self._open()
        out = [(key[0], None, "expired", i, *self._fail(i)) for _, i in late]
        self._close()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"queue": "object", "seq": "Int64", "kind": "object", "id": "Int64", "outcome": "object", "taken": "Int32"}
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pd.DataFrame({name: pd.array(list(values), dtype=kind) if kind != "object" else list(values) for (name, kind), values in zip(kinds.items(), columns, strict=True)})


def outcomes(events: DataFrame, limit: int | None = None, tries: int = 1, lease_seconds: int | None = None) -> DataFrame:
    """(queue, seq, kind, id, outcome, taken) of a stream of events: one row each, taken being how often the id has been taken.

    limit: how many may wait in a queue. tries: how often an id is taken before a failure drops it.
    lease_seconds: an id that has been taken for longer fails by itself (kind `expired`, no seq);
    without it, that waits for a `done` or `failed`. Start it within `rocksdb`.
    """
    known = events.where(F.col("kind").isin("ask", "take", "done", "failed") & F.col("queue").isNotNull()).select("queue", F.col("seq").cast("bigint").alias("seq"), "kind", F.col("id").cast("bigint").alias("id"))
    lease = None if lease_seconds is None else lease_seconds * 1000
    return known.groupBy("queue").transformWithStateInPandas(_Queue(limit, tries, lease), OUTCOME, "Append", "None" if lease is None else "ProcessingTime")
