"""Position fixes pushed by devices, from a log of segments: a source for batches and streams, with a largest age and a rate.

A segment is a file of JSON lines (user_id, event_id, ts, arrived, lat, lng, accuracy; times in microseconds) that is complete when its name appears; names sort in order of
arrival. An offset is a number of segments, so a restarted stream goes on with the first segment that no finished batch held, and every read of a
range of offsets gives the same rows. A fix that was older than ``max_age_ms`` when it arrived is never handed on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wayfold.sources.files import opened

#: How old a fix may be when it arrives, and how long a device may be silent, in milliseconds.
MAX_AGE_MS, TIMEOUT_MS = 4_000, 12_000
SCHEMA = "user_id bigint, event_id bigint, ts timestamp, arrived timestamp, lat double, lng double, accuracy double"
_LINES = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64()), ("ts", pa.int64()), ("arrived", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("accuracy", pa.float64())])
_TIME = pa.timestamp("us", "UTC")


@dataclass
class Segment(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class _Log:
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.max_age = int(options.get("max_age_ms", MAX_AGE_MS)) * 1000
        if self.max_age < 0:
            raise ValueError("max_age_ms can't be negative")

    def segments(self) -> list[str]:
        store, root = opened(self.folder)
        if store.get_file_info(root).type != fs.FileType.Directory:
            return []
        return sorted(x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.extension in ("json", "jsonl") and not x.base_name.startswith(("_", ".")))

    def rows(self, path: str) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        if not store.get_file_info(path).size:
            return
        with store.open_input_stream(path) as f:
            lines = pa.json.read_json(f, parse_options=pa.json.ParseOptions(explicit_schema=_LINES, unexpected_field_behavior="ignore"))
        age = pc.subtract(lines.column("arrived"), lines.column("ts"))
        lines = lines.filter(pc.and_(pc.less_equal(age, self.max_age), pc.greater_equal(age, 0)))
        for batch in lines.to_batches():
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(_TIME) if n in ("ts", "arrived") else batch.column(n) for n in _LINES.names], _LINES.names)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.log = _Log(options)

    def partitions(self) -> Sequence[Segment]:
        return [Segment(p) for p in self.log.segments()] or [Segment("")]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.log.rows(partition.path)


class _Stream(DataSourceStreamReader):
    """Hands out at most ``segments_per_batch`` new segments a batch; how far finished batches came stands in a file of the folder ``progress``, as
    Spark doesn't tell a source where it begins again."""

    def __init__(self, options: dict) -> None:
        self.log = _Log(options)
        self.most = int(options["segments_per_batch"]) if "segments_per_batch" in options else None
        self.progress = options.get("progress")
        if self.most is not None and (self.most < 1 or not self.progress):
            raise ValueError("segments_per_batch is at least 1 and needs a folder for progress")
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        there = len(self.log.segments())
        if self.most is None:
            return {"segments": there}
        if self.last is None:
            self.last = self._done()
        self.last = max(self.last, min(self.last + self.most, there))
        return {"segments": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[Segment]:
        if self.most is not None:  # a batch that is run again after a restart
            self.last = max(self.last or 0, end["segments"])
        return [Segment(p) for p in self.log.segments()[start["segments"] : end["segments"]]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from self.log.rows(partition.path)

    def commit(self, end: dict) -> None:
        if self.progress:
            store, root = opened(self.progress)
            store.create_dir(root, recursive=True)
            staged = f"{root}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(staged) as f:
                f.write(json.dumps(end).encode())
            store.move(staged, f"{root}/done.json")

    def _done(self) -> int:
        store, root = opened(self.progress)
        if store.get_file_info(f"{root}/done.json").type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(f"{root}/done.json") as f:
            return json.loads(f.read())["segments"]


class Positions(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("positions").load(folder)``; options max_age_ms, and for streams segments_per_batch with progress."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All fixes of a log that weren't too old when they arrived."""
    spark.dataSource.register(Positions)
    return spark.read.format("positions").options(**{k: str(v) for k, v in options.items()}).load(folder)


def read_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """read() as a stream."""
    spark.dataSource.register(Positions)
    return spark.readStream.format("positions").options(**{k: str(v) for k, v in options.items()}).load(folder)


def silences(fixes: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """(user_id, after_event, at): where nothing came from a device for longer than the timeout, when that ran out, and the fix that it ran from."""
    by = W.partitionBy("user_id").orderBy("arrived", "event_id")
    until = F.col("arrived") + F.make_interval(secs=F.lit(timeout_ms / 1000))
    told = fixes.select("user_id", F.col("event_id").alias("after_event"), until.alias("at"), F.lead("arrived").over(by).alias("next"))
    return told.filter(F.col("next") > F.col("at")).drop("next")
