"""A first-in-first-out cache of bounded size for each owner, over requests in order of time: in batch, and in Structured Streaming with its entries as list state.

A request for a key that the cache holds is a hit and changes nothing, not even the key's turn to go. Any other is fetched: if that succeeds the key goes in and, beyond
``limit`` entries, the oldest goes out; if it fails the request fails. With ``max_age`` an entry that old counts as gone, whoever asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Fixed value: entries that a cache holds where nothing else is said.
LIMIT = 800
OUTCOMES = "owner long, request_id long, outcome string, evicted string, held int"

Entries = list[tuple[str, int]]


def serve(entries: Entries, key: str, at: int, ok: bool, limit: int, max_age: int | None) -> tuple[Entries, str, str | None]:
    """(entries, outcome, evicted key) after a request at a time in microseconds. Entries are (key, time that it went in), oldest first.

    Entries that have outlived ``max_age`` leave without being reported: only room that a new entry needs evicts.
    """
    if max_age is not None:
        entries = [e for e in entries if at - e[1] < max_age]
    if any(k == key for k, _ in entries):
        return entries, "hit", None
    if not ok:
        return entries, "failed", None
    entries = [*entries, (key, at)]
    return entries[-limit:], "stored", entries[0][0] if len(entries) > limit else None


def _prepared(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("owner").cast("long").alias("owner"), F.col("request_id").cast("long").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("key").cast("string").alias("key"), F.coalesce("ok", F.lit(False)).alias("ok"))


def _checked(limit: int) -> None:
    if limit < 1:
        raise ValueError("a cache holds at least one entry")


def batch(requests: DataFrame, limit: int = LIMIT, max_age: int | None = None) -> DataFrame:
    """(owner, request_id, outcome, evicted, held) of all requests (owner, request_id, ts, key, ok), each owner's in order of ts and request_id.

    Spark sorts; a task passes over its owners' requests batch by batch and holds one cache at a time, so an owner's number of requests doesn't matter.
    Requests with a null key are left out.
    """
    _checked(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, entries = None, []
        for b in batches:
            out = []
            for who, request, at, key, ok in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if who != owner:
                    owner, entries = who, []
                entries, outcome, evicted = serve(entries, key, at, ok, limit, max_age)
                out.append((who, request, outcome, evicted, len(entries)))
            columns = list(zip(*out, strict=True))
            if columns:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["owner", "request_id", "outcome", "evicted", "held"])

    rows = _prepared(requests.filter("key is not null"))
    return rows.repartition("owner").sortWithinPartitions("owner", "at", "request_id").mapInArrow(run, OUTCOMES)


class _Cache(StatefulProcessor):
    """An owner's entries as list state; a cache that has been empty of requests for ``idle_ms`` is dropped by Spark."""

    def __init__(self, limit: int, max_age: int | None, idle_ms: int | None) -> None:
        self.limit, self.max_age, self.idle_ms = limit, max_age, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "key string, at long", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        entries = [(k, at) for k, at in self.entries.get()]
        told = []
        for r in sorted(rows, key=lambda r: (r.at, r.request_id)):
            entries, outcome, evicted = serve(entries, r.key, r.at, r.ok, self.limit, self.max_age)
            told.append(Row(owner=key[0], request_id=r.request_id, outcome=outcome, evicted=evicted, held=len(entries)))
        if entries:
            self.entries.put(entries)
        else:
            self.entries.clear()
        return iter(told)

    def close(self) -> None:
        pass


def stream(requests: DataFrame, limit: int = LIMIT, max_age: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """batch() on a stream: an owner's entries are the only state, at most ``limit``. Requests of a micro-batch are taken in order of time.

    With ``idle_ms`` the state store forgets entries that long after they were last written, in processing time. Needs the RocksDB state store.
    """
    _checked(limit)
    rows = _prepared(requests.filter("key is not null"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("owner").transformWithState(_Cache(limit, max_age, idle_ms), OUTCOMES, "Append", mode)
