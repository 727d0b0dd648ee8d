"""Values looked up for places in batches by a service that may fail, bound to a selection and resumable.

A journal folder holds the selection's digest and a file for every batch that was answered. What earlier layers know isn't asked again. A run that breaks leaves
the batches it has finished; the next run, of the same selection, asks only for the others. A journal of another selection is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.sources.files import opened
from wayfold.sources.layers import content_hash

#: Places of one request, attempts, and seconds that the wait grows by from attempt to attempt.
BATCH, RETRIES, DELAY_S = 100, 4, 0.5
#: Batches that are numbered together.
_RUN = 50

Service = Callable[[list[tuple[float, float]]], Sequence[float | None]]


def place_key(lat: Column, lng: Column) -> list[Column]:
    """Coordinates to seven decimals, as whole numbers: what places are known by."""
    return [F.round(lat.cast("double") * 1e7).cast("bigint").alias("lat7"), F.round(lng.cast("double") * 1e7).cast("bigint").alias("lng7")]


def known_values(layers: dict[str, DataFrame]) -> DataFrame:
    """(lat7, lng7, value, layer) of earlier layers (lat, lng, value); places that they give different values fail. The first layer by order is named."""
    rows = None
    for i, (name, df) in enumerate(layers.items()):
        one = df.filter("value is not null").select(*place_key(F.col("lat"), F.col("lng")), F.col("value").cast("double").alias("value"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("layer")).alias("from"))
        rows = one if rows is None else rows.unionByName(one)
    sums = rows.groupBy("lat7", "lng7").agg(F.min("value").alias("value"), F.max("value").alias("most"), F.min("from").alias("from"))
    fail = F.raise_error(F.format_string("earlier layers disagree at %d, %d: %s and %s", F.col("lat7"), F.col("lng7"), F.col("value").cast("string"), F.col("most").cast("string"))).cast("double")
    return sums.select("lat7", "lng7", F.when(F.col("value") == F.col("most"), F.col("value")).otherwise(fail).alias("value"), F.col("from.layer").alias("layer"))


def _bound(folder: str, digest: str, batch: int, force: bool) -> None:
    """Makes ``folder`` the journal of a selection, or sees that it is."""
    store, root = opened(folder)
    head = f"{root}/selection.json"
    if store.get_file_info(head).type != fs.FileType.NotFound and not force:
        with store.open_input_stream(head) as f:
            found = json.loads(f.read())
        if found != {"selection_sha256": digest, "batch": batch}:
            raise ValueError(f"the journal is of another selection or batch size: {folder}")
        return
    if force and store.get_file_info(root).type != fs.FileType.NotFound:
        for x in store.get_file_info(fs.FileSelector(root)):
            if x.base_name.startswith("batch-"):
                store.delete_file(x.path)
    store.create_dir(root, recursive=True)
    _put(store, head, {"selection_sha256": digest, "batch": batch})


def _put(store: fs.FileSystem, path: str, record: dict) -> None:
    staged = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(staged) as f:
        f.write((json.dumps(record, indent=2, sort_keys=True) + "\n").encode())
    store.move(staged, path)


class StatusError(RuntimeError):
    """An answer with a status that says that there is none."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


#: Statuses that may be gone the next time.
PASSING = (429, 500, 502, 503, 504)


def passing(e: Exception) -> bool:
    """Whether a failure may be gone the next time: a busy or broken service, no connection, no answer in time."""
    return e.status in PASSING if isinstance(e, StatusError) else isinstance(e, (ConnectionError, TimeoutError))


def asked(service: Service, places: list[tuple[float, float]], retries: int, delay: float, again: Callable[[Exception], bool] | None = None) -> tuple[list[float], int]:
    """(values, attempts) of one batch. An answer that is too short, or lacks a value, counts as none. Failures that ``again`` says no to aren't tried again."""
    for attempt in range(1, retries + 1):
        try:
            values = list(service(places))
            if len(values) != len(places) or any(v is None for v in values):
                raise ValueError(f"{sum(v is not None for v in values)} values for {len(places)} places")
            return [float(v) for v in values], attempt
        except Exception as e:
            if attempt == retries or again and not again(e):
                raise RuntimeError(f"a batch failed after {attempt} attempts: {e}") from e
            time.sleep(delay * attempt)
    raise ValueError("at least one attempt")


def lookup(selection: DataFrame, service: Service, folder: str, *, key: str = "id", known: dict[str, DataFrame] | None = None, batch: int = BATCH, retries: int = RETRIES, delay: float = DELAY_S, again: Callable[[Exception], bool] | None = None, force: bool = False) -> DataFrame:
    """``selection`` (key, lat, lng, ...) with value, source (reused or fetched) and origin (the layer, or the batch's file).

    Places are asked for once each, in batches that Spark deals out; ``service`` takes (lat, lng) pairs. Reading the result again asks nothing again. With ``force``
    an old journal is forgotten. Failures are tried again, or with ``again`` (such as passing()) only those that it says yes to. Rows without coordinates fail.
    """
    spark = selection.sparkSession
    digest = content_hash(selection.select(key, "lat", "lng"), "selection").first().content_hash
    _bound(folder, digest, batch, force)
    fail = F.raise_error(F.concat(F.lit("no coordinates: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    rows = selection.filter(F.when(F.coalesce(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.lit(False)), F.lit(True)).otherwise(fail))
    rows = rows.select("*", *place_key(F.col("lat"), F.col("lng")))
    old = known_values(known) if known else spark.createDataFrame([], "lat7 bigint, lng7 bigint, value double, layer string")
    wanted = rows.select("lat7", "lng7").distinct().join(old, ["lat7", "lng7"], "left_anti")
    runs = max(1, -(-wanted.count() // (batch * _RUN)))
    nth = F.row_number().over(W.partitionBy("run").orderBy("lat7", "lng7")) - 1
    wanted = wanted.withColumn("run", F.pmod(F.xxhash64("lat7", "lng7"), F.lit(runs)).cast("int")).withColumn("nth", F.floor(nth / batch).cast("int"))

    def fetch(table: pa.Table) -> pa.Table:
        store, root = opened(folder)
        table = table.sort_by([("lat7", "ascending"), ("lng7", "ascending")])
        name = f"batch-{table.column('run')[0].as_py()}-{table.column('nth')[0].as_py()}.json"
        places = [(a / 1e7, b / 1e7) for a, b in zip(table.column("lat7").to_pylist(), table.column("lng7").to_pylist(), strict=True)]
        record = None
        if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{root}/{name}") as f:
                record = json.loads(f.read())
            if record["selection_sha256"] != digest or [tuple(p) for p in record["places"]] != places:
                record = None
        if record is None:
            values, attempts = asked(service, places, retries, delay, again)
            record = {"selection_sha256": digest, "places": places, "values": values, "attempts": attempts}
            _put(store, f"{root}/{name}", record)
        return pa.table({"lat7": table.column("lat7"), "lng7": table.column("lng7"), "value": pa.array(record["values"], pa.float64()), "origin": pa.array([name] * len(places))})

    new = wanted.groupBy("run", "nth").applyInArrow(fetch, "lat7 bigint, lng7 bigint, value double, origin string")
    values = old.select("lat7", "lng7", "value", F.lit("reused").alias("source"), F.col("layer").alias("origin")).unionByName(new.withColumn("source", F.lit("fetched")))
    return rows.join(values, ["lat7", "lng7"], "left").drop("lat7", "lng7")
