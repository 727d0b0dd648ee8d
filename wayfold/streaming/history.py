"""A bounded history of visited places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: places that a history holds.
DEPTH = 12
SCHEMA = "user_id long, current string, history array<string>"


def moved(current: str | None, history: list[str], op: str, target: str | None, depth: int) -> tuple[str | None, list[str]]:
    """(current, history) after one event.

    A visit to another place puts the present one on the history, of which the last ``depth`` are kept; back returns to the last of them and does
    nothing without one; reset forgets them and goes to its target.
    """
    if op == "reset":
        return target, []
    if op == "back":
        return (history[-1], history[:-1]) if history else (current, history)
    return target, [*history, current][-depth:] if current is not None and current != target else history


def trails(events: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(user_id, current, history) after all events (user_id, event_id, ts, op, target), in order of ts and event_id.

    Spark sorts; a task passes over its users' events batch by batch and holds one history at a time, so a user's number of events doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, current, history, begun = None, None, [], False
        done = []
        for b in batches:
            for who, op, target in zip(*(b.column(c).to_pylist() for c in ("user_id", "op", "target")), strict=True):
                if not begun or who != user:
                    if begun:
                        done.append((user, current, history))
                    user, current, history, begun = who, None, [], True
                current, history = moved(current, history, op, target, depth)
            if len(done) >= 1000:
                yield _rows(done)
                done = []
        if begun:
            done.append((user, current, history))
        if done:
            yield _rows(done)

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id", "op", F.col("target").cast("string").alias("target"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "op", "target").mapInArrow(run, SCHEMA)


def _rows(done: list) -> pa.RecordBatch:
    users, places, trails_of = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(places, pa.string()), pa.array(trails_of, pa.list_(pa.string()))], ["user_id", "current", "history"])
