"""Feature collections as files: bounded documents by map cell, and read back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.sources import files

#: Features of a document at most.
MOST = 1000
_FILL = 0.8
_DOCUMENT = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def collections(features: DataFrame, by: list[str], key: str, most: int = MOST) -> DataFrame:
    """(path, content): documents of at most ``most`` features (by, key, feature as JSON text) of one cell; features that are null are left out.

    A cell with many features is dealt out by a hash of their keys before they are numbered, so that no cell's features meet in one task.
    """
    rows = features.filter("feature is not null")
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(most * _FILL))).cast("int").alias("_bins"))
    dealt = rows.join(sizes, by).withColumn("_bin", F.pmod(F.xxhash64(key), F.col("_bins")).cast("int"))
    nth = F.row_number().over(W.partitionBy(*by, "_bin").orderBy(key, "feature")) - 1
    dealt = dealt.withColumn("_part", F.floor(nth / most).cast("int"))
    docs = dealt.groupBy(*by, "_bin", "_part").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "feature"))).alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}"))
    path = F.concat(F.concat_ws("/", *(F.col(c).cast("string") for c in by)), F.lit("/"), F.col("_bin").cast("string"), F.lit("-"), F.col("_part").cast("string"), F.lit(".geojson"))
    return docs.select(path.alias("path"), F.encode(text, "utf-8").alias("content"))


def write_collections(features: DataFrame, folder: str, by: list[str], key: str, most: int = MOST) -> DataFrame:
    """collections() as files; returns the manifest."""
    return files.write_files(collections(features, by, key, most), folder)


def read_collections(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_features, properties, kind, coordinates as JSON text) of all features of a folder's documents; a document that is no collection fails."""
    docs = files.read_files(spark, folder).select("path", F.from_json(F.decode("content", "utf-8"), _DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    fail = F.raise_error(F.concat(F.lit("no feature collection: "), F.col("path")))
    # in what is exploded, so that no filter that the plan puts before it drops the document first
    found = F.when((F.col("d.type") == "FeatureCollection") & F.col("d.features").isNotNull(), F.col("d.features")).otherwise(fail)
    each = docs.select("path", F.size("d.features").alias("n_features"), F.explode(found).alias("f"))
    return each.select("path", "n_features", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
