"""Layers published as documents, with a manifest of their bytes and hashes, and the gate, phases and staleness that go by it."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import files
from wayfold.sources.layers import canonical_json

#: Rows of a document.
ROWS = 1000
PHASES = ("initial", "hydrate", "deferred")


@dataclass(frozen=True)
class Layer:
    """What a contract says of a layer: its key, columns and version, whether a release needs it, and when it is loaded."""

    name: str
    key: str
    columns: tuple[str, ...]
    schema_version: int = 1
    required: bool = True
    phase: str = "initial"


def documents(rows: DataFrame, layer: Layer, per_document: int = ROWS) -> DataFrame:
    """(path, content): a layer's rows as canonical JSON documents, those of ``per_document`` consecutive keys together.

    The key is a whole number that tells rows apart; the same rows give the same bytes, however they were partitioned.
    """
    part = F.floor(F.col(layer.key) / per_document).cast("long")
    text = rows.select(part.alias("part"), F.col(layer.key).alias("k"), canonical_json(list(layer.columns)).alias("row"))
    docs = text.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("k", "row"))).alias("rows"))
    body = F.concat(F.lit(f'{{"layer":{json.dumps(layer.name)},"rows":['), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit(f'],"schema_version":{layer.schema_version}}}'))
    return docs.select(F.concat(F.lit(f"{layer.name}/"), F.col("part").cast("string"), F.lit(".json")).alias("path"), F.encode(body, "utf-8").alias("content"))


def publish(spark: SparkSession, layers: dict[Layer, DataFrame | None], folder: str, per_document: int = ROWS) -> DataFrame:
    """Writes all layers that there are; returns the manifest (path, bytes, sha256). A layer that a release needs and that is None fails."""
    out = None
    for layer, rows in layers.items():
        if rows is None:
            if layer.required:
                raise ValueError(f"a required layer could not be published: {layer.name}")
            continue
        docs = documents(rows, layer, per_document)
        out = docs if out is None else out.unionByName(docs)
    if out is None:
        out = spark.createDataFrame([], "path string, content binary")
    return files.write_files(out, folder)


def layer_sums(manifest: DataFrame, layers: list[Layer]) -> DataFrame:
    """(layer, required, phase, available, files, bytes) of the contract's layers."""
    known = manifest.sparkSession.createDataFrame([(x.name, x.required, x.phase) for x in layers], "layer string, required boolean, phase string")
    sums = manifest.groupBy(F.substring_index("path", "/", 1).alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    # a row for each layer on both sides
    return known.join(sums, "layer", "left").select("layer", "required", "phase", F.col("files").isNotNull().alias("available"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def gate(listed: DataFrame, found: DataFrame, layers: list[Layer], *, most_bytes: int, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(rule, failures, ok): files are those of the manifest, whole and unchanged, of layers in the contract; none matches a forbidden pattern;
    required layers are there; all fit in a budget of bytes."""
    spark = listed.sparkSession
    faults = files.faults(listed, found).groupBy(F.col("fault").alias("rule")).agg(F.count(F.lit(1)).alias("failures"))
    names = [x.name for x in layers]
    outside = found.agg(F.count_if(~F.substring_index("path", "/", 1).isin(names)).alias("outside_contract"), F.count_if(F.col("path").rlike("|".join(fnmatch.translate(p) for p in forbidden) or "(?!)")).alias("forbidden"))
    sums = layer_sums(listed, layers).agg(F.count_if(F.col("required") & ~F.col("available")).alias("required_layers"), F.when(F.coalesce(F.sum("bytes"), F.lit(0)) > most_bytes, 1).otherwise(0).cast("long").alias("budget"))
    each = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("failures")) for c in df.columns))).alias("r")).select("r.*")
    rules = spark.createDataFrame([(r,) for r in ("repeated", "missing", "unlisted", "bytes", "sha256")], "rule string")
    rows = rules.join(faults, "rule", "left").select("rule", F.coalesce("failures", F.lit(0)).alias("failures"))
    return rows.unionByName(each(outside)).unionByName(each(sums)).withColumn("ok", F.col("failures") == 0)


def load(spark: SparkSession, folder: str, layers: list[Layer], phase: str, schema: dict[str, str]) -> dict[str, DataFrame]:
    """The rows of the layers of one phase, read against the manifest. A document that is no JSON, of another layer or an unknown version fails by its path."""
    if phase not in PHASES:
        raise ValueError(f"no phase {phase}")
    whole = files.read_files(spark, folder).withColumn("layer", F.substring_index("path", "/", 1))
    out = {}
    for x in (x for x in layers if x.phase == phase):
        head = f"layer string, schema_version int, rows array<struct<{schema[x.name]}>>"
        docs = whole.filter(F.col("layer") == x.name).select("path", F.from_json(F.decode("content", "utf-8"), head).alias("d"))
        fail = F.raise_error(F.concat(F.lit("not a document of its layer and version: "), F.col("path")))
        fine = (F.col("d.layer") == x.name) & (F.col("d.schema_version") == x.schema_version) & F.col("d.rows").isNotNull()
        # in what is exploded, so that no filter that the plan puts before it drops the document first
        out[x.name] = docs.select(F.explode(F.when(F.coalesce(fine, F.lit(False)), F.col("d.rows")).otherwise(fail)).alias("r")).select("r.*")
    return out


def resolved(spark: SparkSession, folders: list[str], layers: list[Layer], schema: dict[str, str]) -> dict[str, tuple[str, DataFrame]]:
    """(folder, rows) of each layer, from the first of the folders that publishes it: a build's own before the canonical ones.

    A layer that no folder has fails if it is required and is left out otherwise. What is read is checked as load() checks it: a folder that has a layer in another version fails
    instead of passing it on to the next.
    """
    there = {}
    for folder in folders:
        try:
            listed = files.manifest(spark, folder)
        except FileNotFoundError:
            continue
        there[folder] = {r.layer for r in listed.select(F.substring_index("path", "/", 1).alias("layer")).distinct().collect()}
    out = {}
    for x in layers:
        folder = next((f for f in folders if x.name in there.get(f, ())), None)
        if folder is not None:
            out[x.name] = (folder, load(spark, folder, [x], x.phase, schema)[x.name])
        elif x.required:
            raise FileNotFoundError(f"a required layer is in none of the folders: {x.name}")
    return out


def input_set(manifest: DataFrame) -> DataFrame:
    """(layer, files, sha256) of what a composition is made from: for each layer one digest over its files' sums, whatever their order."""
    sums = [F.sum(F.conv(F.substring("sha256", a, 8), 16, 10).cast("long")).cast("string") for a in (1, 9, 17, 25, 33, 41, 49, 57)]
    return manifest.groupBy(F.substring_index("path", "/", 1).alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.concat_ws("-", *sums), 256).alias("sha256"))


def stale(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(layer, fault): inputs of a composition that aren't what they were when it was made: changed, gone or new."""
    old, new = recorded.select("layer", F.col("sha256").alias("was")), now.select("layer", F.col("sha256").alias("is"))
    both = old.join(new, "layer", "full")
    fault = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "changed")
    return both.select("layer", fault.alias("fault")).filter("fault is not null")
