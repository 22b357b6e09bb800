"""The queue of follow-up work against a literal one."""

from __future__ import annotations

import random
from collections import deque

from claimloom.plans.scratch import scratch_path
from claimloom.streaming import extraction, followups


def literal(events: list[tuple], limit: int | None, tries: int) -> list[tuple]:
    waiting, running, out = {}, {}, []
    for q, seq, kind, i in events:
        line, busy = waiting.setdefault(q, deque()), running.setdefault(q, {})
        at = next((n for n, (x, _) in enumerate(line) if x == i), None)
        if kind == "take":
            if not line:
                out.append((q, seq, kind, None, "EMPTY", 0))
                continue
            head, taken = line.popleft()
            busy[head] = taken + 1
            out.append((q, seq, kind, head, "TAKEN", taken + 1))
        elif i is None:
            out.append((q, seq, kind, None, "UNKNOWN", 0))
        elif kind == "ask":
            if at is not None:
                out.append((q, seq, kind, i, "DUPLICATE", line[at][1]))
            elif limit is not None and len(line) >= limit:
                out.append((q, seq, kind, i, "FULL", 0))
            else:
                line.append((i, 0))
                out.append((q, seq, kind, i, "ACCEPTED", 0))
        elif i not in busy:
            out.append((q, seq, kind, i, "UNKNOWN", 0))
        elif kind == "done":
            out.append((q, seq, kind, i, "DONE", busy.pop(i)))
        else:
            taken = busy.pop(i)
            if at is not None:
                line[at] = (i, min(line[at][1], taken))
                out.append((q, seq, kind, i, "DUPLICATE", taken))
            elif taken >= tries:
                out.append((q, seq, kind, i, "DROPPED", taken))
            else:
                line.append((i, taken))
                out.append((q, seq, kind, i, "RETRIED", taken))
    return out


def run(spark, batches: list[list[tuple]], **settings) -> list[tuple]:
    path = scratch_path(spark, "asked")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, followups.EVENT).coalesce(1).write.parquet(f"{path}/batch={n}")
    stream = spark.readStream.schema(followups.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")
    with followups.rocksdb(spark):
        got = extraction.drain(followups.outcomes(stream, **settings), "append", scratch_path(spark, "out"), scratch_path(spark, "state"))
        return sorted((tuple(r) for r in got.collect()), key=repr)


def test_outcomes_equal_a_literal_queue_over_several_batches(spark):
    rng = random.Random(7)
    events = [(rng.choice("aaab"), n, rng.choice(["ask"] * 4 + ["take"] * 4 + ["done"] + ["failed"] * 5), rng.choice([None, *range(5)])) for n in range(600)]
    batches = [events[k : k + 200] for k in (0, 200, 400)]
    for b in batches:
        rng.shuffle(b)
    want = literal(events, 3, 2)
    assert {o for *_, o, _ in want} == {"ACCEPTED", "DUPLICATE", "FULL", "TAKEN", "EMPTY", "DONE", "UNKNOWN", "RETRIED", "DROPPED"}
    assert run(spark, batches, limit=3, tries=2) == sorted(want, key=repr)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_events_that_say_nothing_and_asks_of_a_commit(spark):
    assert run(spark, [[(None, 1, "ask", 1), ("q", 2, "sing", 1), ("q", 3, "ask", 5), ("q", 3, "ask", 5)]]) == [("q", 3, "ask", 5, "ACCEPTED", 0), ("q", 3, "ask", 5, "DUPLICATE", 0)]
    affected = spark.createDataFrame([(9,), (3,), (3,), (None,), (4,)], "id bigint")
    assert sorted(r.id for r in followups.asks(affected, "q", 1, 2).collect()) == [3, 4]
    dealt = followups.dealt(spark.createDataFrame([("q", n, "ask", n % 5) for n in range(40)], followups.EVENT), 3)
    assert dealt.select("queue", "id").distinct().count() == 5


class Counted(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_neighbouring_entries_share_calls_to_the_store():
    store = Counted()
    first = followups._Map(store, True)
    for i in range(-30, 90):
        first.put(i, (i, 1))
    first.flush()
    assert store.calls == 3  # blocks from -64, 0 and 64; an empty state isn't read
    second = followups._Map(store, False)
    assert second.get(-30) == [-30, 1] and second.get(89) == [89, 1] and second.get(90) is None
    for i in range(-30, 0):
        second.put(i, None)
    second.flush()
    assert store.calls == 6 and set(store) == {(0,), (1,)}  # two read, one removed, the unchanged one left alone
