"""Layers: versioned tables with a declared schema, read strictly and written with a manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("elevation", T.DoubleType())])
TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
WAY = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_version", T.StringType()), T.StructField("_timestamp", T.StringType()), T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.StringType())]))), T.StructField("tag", TAG)])
NODE = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_version", T.StringType()), T.StructField("_timestamp", T.StringType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("tag", TAG)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_document(spark: SparkSession, path: str, rows: str, row: T.StructType, version: str | None = None, *, lines: bool = False) -> DataFrame:
    """The rows of a layer document (a JSON object with a header), by their declared schema; malformed files and other versions fail.

    With ``lines`` each line is a document, so that a large layer is many of them.
    """
    schema = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField(rows, T.ArrayType(row))])
    header = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=not lines)
    if version is not None:
        wrong = F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce("schema_version", F.lit("none"))))
        header = header.withColumn(rows, F.when(F.col("schema_version") == version, F.col(rows)).otherwise(wrong.cast(T.ArrayType(row))))
    return header.select(F.explode(rows).alias("row")).select("row.*")


def read_point_elevations(spark: SparkSession, path: str) -> DataFrame:
    """(lat7, lng7, elevation): keyed by coordinates in whole 1e-7 degrees, so that joins never compare doubles."""
    points = read_document(spark, path, "points", POINT)
    return points.select(F.round(F.col("lat") * 1e7).cast("long").alias("lat7"), F.round(F.col("lng") * 1e7).cast("long").alias("lng7"), "elevation")


def tag_map(tags: Column) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(tags, F.array().cast(TAG)), lambda t: F.struct(t["_k"], t["_v"])))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, refs, tags) of OSM XML tiles; a way in several tiles comes from the first by file name."""
    ways = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path).withColumn("file", F.input_file_name())
    ways = ways.select(F.col("_id").alias("id"), F.struct("file", F.transform(F.coalesce("nd", F.array().cast(WAY["nd"].dataType)), lambda n: n["_ref"]).alias("refs"), tag_map(F.col("tag")).alias("tags")).alias("row"))
    first = ways.groupBy("id").agg(F.min_by("row", "row.file").alias("row"))
    return first.select("id", "row.refs", "row.tags")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lng, tags, tiles, consistent) of OSM XML tiles, with the tiles that hold each node; consistent if they agree on its place."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path).withColumn("file", F.input_file_name())
    nodes = nodes.withColumn("tags", tag_map(F.col("tag")))
    out = nodes.groupBy(F.col("_id").alias("id")).agg(F.max_by("_lat", "file").alias("lat"), F.max_by("_lon", "file").alias("lng"), F.max_by("tags", "file").alias("tags"), F.array_sort(F.collect_set("file")).alias("tiles"), F.count_distinct("_lat", "_lon").alias("places"))
    return out.select("id", "lat", "lng", "tags", "tiles", (F.col("places") == 1).alias("consistent"))


def reconciled_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lng, version, timestamp, tags, tiles) of all tiles; a node whose tiles disagree on its place fails.

    Versions are compared as numbers, tags merged, a later file's over an earlier one's.
    """
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path).withColumn("file", F.input_file_name())
    y, x = (F.round(F.col(c) * 1e7).cast("long") for c in ("_lat", "_lon"))
    one = nodes.groupBy(F.col("_id").alias("id")).agg(F.min("_lat").alias("lat"), F.min("_lon").alias("lng"), F.count_distinct(y, x).alias("places"), F.max(F.col("_version").try_cast("long")).alias("version"), F.max("_timestamp").alias("timestamp"), F.array_sort(F.collect_set("file")).alias("tiles"))
    fail = F.raise_error(F.concat(F.lit("node differs across tiles: "), F.col("id"))).cast("double")
    one = one.withColumn("lat", F.when(F.col("places") == 1, F.col("lat")).otherwise(fail)).drop("places")
    return one.join(_merged_tags(nodes), "id", "left").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def _merged_tags(elements: DataFrame) -> DataFrame:
    tags = elements.select(F.col("_id").alias("id"), "file", F.explode("tag").alias("t"))
    last = tags.groupBy("id", F.col("t._k").alias("k")).agg(F.max_by("t._v", "file").alias("v"))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


BOUNDS = T.StructType([T.StructField(f"_{c}", T.DoubleType()) for c in ("minlat", "minlon", "maxlat", "maxlon")])


def exact_tiles(spark: SparkSession, path: str, expected: DataFrame, name: Column) -> DataFrame:
    """(name, south, west, north, east, bytes, sha256) of the tile files of a folder, which must be those of ``expected`` (name, south, west, north, east), no more and no fewer.

    ``name`` tells a tile by the column file. A file that is missing, isn't expected, declares no bounds, more than one or others fails by its name.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = files.select(name.alias("name"), "bytes", "sha256")
    found = spark.read.format("xml").option("rowTag", "bounds").schema(BOUNDS).load(path).withColumn("file", F.input_file_name())
    found = found.select(name.alias("name"), F.struct(*(F.col(f"_{a}").alias(b) for a, b in (("minlat", "south"), ("minlon", "west"), ("maxlat", "north"), ("maxlon", "east")))).alias("is"))
    found = found.groupBy("name").agg(F.max("is").alias("is"), F.count(F.lit(1)).alias("declared"))
    want = expected.select("name", F.struct(*(F.col(c).cast("double").alias(c) for c in ("south", "west", "north", "east"))).alias("was"))
    both = files.groupBy("name").agg(F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"), F.count(F.lit(1)).alias("copies")).join(want, "name", "full").join(found, "name", "left")
    fault = F.when(F.col("copies").isNull(), "tile is missing: ").when(F.col("was").isNull(), "tile isn't expected: ").when(F.col("copies") > 1, "tile is there twice: ")
    fault = fault.when(F.coalesce("declared", F.lit(0)) != 1, "tile lacks its bounds: ").when(~F.col("is").eqNullSafe(F.col("was")), "tile's bounds drifted: ")
    row = F.when(fault.isNull(), F.struct("is.*", "bytes", "sha256")).otherwise(F.raise_error(F.concat(fault, F.col("name"))))
    return both.select("name", row.alias("row")).select("name", "row.*")


def adjacency(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(lat7, lng7, to_lat7, to_lng7, way, direction, from_node, to_node, tags): every pair of neighbours on a way (id, refs, tags) both ways, by where its nodes lie.

    A pair of which a node (id, lat, lng) isn't known is left out; a node that follows itself is a pair.
    """
    at = nodes.select("id", F.struct(F.round(F.col("lat") * 1e7).cast("long").alias("lat7"), F.round(F.col("lng") * 1e7).cast("long").alias("lng7")).alias("at"))
    n = F.size("refs")
    pairs = ways.filter(n > 1).select(F.col("id").alias("way"), "tags", F.explode(F.zip_with(F.slice("refs", 1, n - 1), F.slice("refs", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("way", "tags", "p.*")
    pairs = pairs.join(at.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(at.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
    way = lambda d, x, y: F.struct(F.col(f"at_{x}").alias("from"), F.col(f"at_{y}").alias("to"), F.lit(d).alias("direction"), F.col(x).alias("from_node"), F.col(y).alias("to_node"))
    both = pairs.select("way", "tags", F.explode(F.array(way("forward", "a", "b"), way("reverse", "b", "a"))).alias("e"))
    return both.select("e.from.*", F.col("e.to.lat7").alias("to_lat7"), F.col("e.to.lng7").alias("to_lng7"), "way", "e.direction", "e.from_node", "e.to_node", "tags")


def reconciled_ways(spark: SparkSession, path: str, nodes: DataFrame, *, merge_tags: bool = False) -> DataFrame:
    """(id, refs, version, timestamp, tags, n_tiles, missing_refs) of all tiles; a way whose tiles disagree on its nodes or tags fails.

    With ``merge_tags`` tags may differ and are merged, a later file's over an earlier one's. missing_refs are the nodes, each once, that no tile holds: a way
    may lead out of what was read.
    """
    ways = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path).withColumn("file", F.input_file_name())
    refs = F.transform(F.coalesce("nd", F.array().cast(WAY["nd"].dataType)), lambda n: n["_ref"])
    entries = F.array_sort(F.transform(F.coalesce("tag", F.array().cast(TAG)), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))))
    ways = ways.select(F.col("_id").alias("id"), refs.alias("refs"), entries.alias("entries"), "_version", "_timestamp", "file")
    one = ways.groupBy("id").agg(F.min("refs").alias("refs"), F.max("refs").alias("_refs"), F.min("entries").alias("entries"), F.max("entries").alias("_entries"), F.max(F.col("_version").try_cast("long")).alias("version"), F.max("_timestamp").alias("timestamp"), F.count_distinct("file").alias("n_tiles"))
    same = (F.col("refs") == F.col("_refs")) & (F.lit(merge_tags) | (F.col("entries") == F.col("_entries")))
    fail = F.raise_error(F.concat(F.lit("way differs across tiles: "), F.col("id"))).cast("array<string>")
    one = one.withColumn("refs", F.when(same, F.col("refs")).otherwise(fail)).select("id", "refs", "version", "timestamp", F.map_from_entries("entries").alias("tags"), "n_tiles")
    if merge_tags:
        each = ways.select("id", "file", F.explode("entries").alias("e")).groupBy("id", "e.k").agg(F.max_by("e.v", "file").alias("v"))
        merged = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))
        one = one.drop("tags").join(merged, "id", "left").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    used = one.select("id", F.explode("refs").alias("ref"))
    missing = used.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("missing_refs"))
    return one.join(missing, "id", "left").withColumn("missing_refs", F.coalesce("missing_refs", F.array().cast("array<string>")))


def wanted(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """The elements (id, ...) that a list of ids names; an id without an element fails."""
    found = ids.select("id").distinct().join(elements.withColumn("_found", F.lit(True)), "id", "left")
    fail = F.raise_error(F.concat(F.lit("wanted element is missing: "), F.col("id"))).cast("boolean")
    return found.filter(F.when(F.col("_found"), F.lit(True)).otherwise(fail)).drop("_found")


def read_elements(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Elements (type, id, ...) of JSON documents, one a line, each with a list ``elements``; of several with one type and id the last by file and place."""
    schema = T.StructType([T.StructField("elements", T.ArrayType(row))])
    docs = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name()).withColumn("line", F.monotonically_increasing_id())
    each = docs.select("file", "line", F.posexplode("elements").alias("at", "e"))
    return each.groupBy(F.col("e.type").alias("_type"), F.col("e.id").alias("_id")).agg(F.max_by("e", F.struct("file", "line", "at")).alias("e")).select("e.*")


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with its fields in order of their names, nulls included: the same text for the same row, whoever writes it."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def read_ids(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(id) of a text file with one id a line. With ``expected``, a list of another length or with a repeated id fails."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
    if expected is None:
        return ids
    counted = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).select(F.when((F.col("n") == expected) & (F.col("d") == expected), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("id list of "), F.col("n").cast("string"), F.lit(" rows, "), F.col("d").cast("string"), F.lit(" different"))).cast("boolean")).alias("_whole"), F.lit(1).alias("_one"))
    # one row
    return ids.withColumn("_one", F.lit(1)).join(F.broadcast(counted), "_one").filter("_whole").select("id")


def write_layers(layers: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each layer as Parquet and return a manifest: layer, n_rows, content_hash (of the rows, whatever their order)."""
    rows = []
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append(content_hash(df.sparkSession.read.parquet(f"{folder}/{name}"), name))
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def content_hash(df: DataFrame, name: str) -> DataFrame:
    """(layer, n_rows, content_hash): a SHA-256 over sums of the rows' own, so the order and the files don't matter.

    A row's digest covers its values by column name, each with its length before it; null differs from every text.
    """
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = F.sha2(F.concat(*(part(c) for c in sorted(df.columns))), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("long")), F.lit(0)).cast("string") for a in (1, 9, 17, 25)]
    total = df.select(digest.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), *(x.alias(f"s{i}") for i, x in enumerate(sums)))
    return total.select(F.lit(name).alias("layer"), "n_rows", F.sha2(F.concat_ws("-", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("content_hash"))


def publication(spark: SparkSession, folder: str, layers: dict[str, bool]) -> DataFrame:
    """(layer, required, status, n_rows, columns) of a set of layers, which are required or not; a required layer that isn't there fails.

    A layer that isn't there and needn't be is unavailable. Whether it is comes from Spark's own reader, so any store will do.
    """
    rows = None
    for name, required in layers.items():
        try:
            df = table(spark, folder, name)
        except AnalysisException:
            if required:
                raise
            df = None
        if df is None:
            one = spark.createDataFrame([(name, required, "unavailable", None, None)], "layer string, required boolean, status string, n_rows long, columns string")
        else:
            one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), F.lit(required).alias("required"), F.lit("ready").alias("status"), "n_rows", F.lit(" ".join(df.columns)).alias("columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
