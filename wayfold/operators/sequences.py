"""Order-dependent measures along polylines, one row a vertex: (line, pos, lat, lng, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo, normalize
from wayfold.sources.scratch import cut


def _along(line: str = "line"):
    return W.partitionBy(line).orderBy("pos")


def with_steps(vertices: DataFrame) -> DataFrame:
    """Adds step_m, the distance from the vertex before (0 at the first), and along_m, their running sum."""
    before = lambda c: F.lag(c).over(_along())
    step = F.coalesce(geo.haversine(before("lat"), before("lng"), F.col("lat"), F.col("lng")), F.lit(0.0))
    out = vertices.withColumn("step_m", step)
    return out.withColumn("along_m", F.sum("step_m").over(_along().rowsBetween(W.unboundedPreceding, 0)))


def lengths(vertices: DataFrame) -> DataFrame:
    """(line, n_vertices, length_m)"""
    return with_steps(vertices).groupBy("line").agg(F.count(F.lit(1)).alias("n_vertices"), F.round(F.sum("step_m"), 3).alias("length_m"))


def climbs(vertices: DataFrame) -> DataFrame:
    """(line, ascent_m, descent_m, low_m, high_m) of the column z."""
    delta = F.col("z") - F.lag("z").over(_along())
    up = vertices.withColumn("_d", F.coalesce(delta, F.lit(0.0))).groupBy("line")
    return up.agg(F.round(F.sum(F.greatest("_d", F.lit(0.0))), 3).alias("ascent_m"), F.round(F.sum(F.greatest(-F.col("_d"), F.lit(0.0))), 3).alias("descent_m"), F.min("z").alias("low_m"), F.max("z").alias("high_m"))


def run_lengths(vertices: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Runs of vertices with one signature: (line, run, <signature>, n, distance_m); distance sums the column d."""
    same = F.lit(True)
    for c in signature:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(_along()))
    starts = vertices.withColumn("_new", F.when(same & F.lag("pos").over(_along()).isNotNull(), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("_new").over(_along().rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("line", "run", *signature).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 3).alias("distance_m"))


def keep_every(vertices: DataFrame, metres: float) -> DataFrame:
    """(line, pos) of vertices kept by a distance that starts anew at each kept one; first and last always stay.

    The accumulator resets, which no window frame can do: a fold over each line's ordered steps.
    """
    steps = with_steps(vertices).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("pos", "step_m"))).alias("v"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("kept"))

    def fold(acc, x):
        total = acc["sum"] + x["step_m"]
        hit = (total >= metres) | (F.size(acc["kept"]) == 0)
        return F.struct(F.when(hit, F.lit(0.0)).otherwise(total).alias("sum"), F.when(hit, F.concat(acc["kept"], F.array(x["pos"].cast("bigint")))).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate("v", zero, fold, lambda acc: acc["kept"])
    last = F.element_at("v", -1)["pos"].cast("bigint")
    return steps.select("line", F.explode(F.array_distinct(F.concat(kept, F.array(last)))).alias("pos"))


def resample(vertices: DataFrame, spacing: float) -> DataFrame:
    """Equally spaced points along each line: (line, k, at_m, lat, lng, gap_m), about ``spacing`` apart, ends included.

    A line of length L gives max(1, ceil(L / spacing)) intervals; a target between two vertices is interpolated. Lines with
    one vertex are left out.
    """
    steps = with_steps(vertices)
    following = lambda c: F.lead(c).over(_along())
    spans = steps.select("line", "lat", "lng", "along_m", following("along_m").alias("to_m"), following("lat").alias("lat2"), following("lng").alias("lng2"), F.max("along_m").over(W.partitionBy("line")).alias("length"), F.max("pos").over(W.partitionBy("line")).alias("last"), following("pos").alias("next_pos"))
    spans = spans.filter("next_pos is not null")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / spacing)).cast("int")
    gap = F.col("length") / n
    # a span owns the targets in [along, to); the last one its end too
    first = F.ceil(F.col("along_m") / gap)
    until = F.when(F.col("next_pos") == F.col("last"), n).otherwise(F.ceil(F.col("to_m") / gap) - 1)
    usable = spans.withColumn("n", n).withColumn("gap", gap).filter("length > 0").withColumn("_from", first.cast("int")).withColumn("_to", F.least(until, F.col("n")).cast("int")).filter("_from <= _to and to_m > along_m")
    points = usable.withColumn("k", F.explode(F.sequence("_from", "_to"))).withColumn("at_m", F.least(F.col("k") * F.col("gap"), F.col("length")))
    share = F.least(F.lit(1.0), (F.col("at_m") - F.col("along_m")) / (F.col("to_m") - F.col("along_m")))
    mixed = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * share, 8)
    return points.select("line", "k", F.round("at_m", 3).alias("at_m"), mixed("lat", "lat2").alias("lat"), mixed("lng", "lng2").alias("lng"), F.col("gap").alias("gap_m"))


def profile_summary(samples: DataFrame, digits: int = 2) -> DataFrame:
    """(line, samples, start_m, end_m, low_m, high_m, ascent_m, descent_m, max_grade, min_grade) of elevations (line, k, z, gap_m) in order of k.

    Metres are rounded to ``digits``; grades are in percent over one gap, 0 for a line with one sample.
    """
    delta = F.col("z") - F.lag("z").over(W.partitionBy("line").orderBy("k"))
    at = samples.withColumn("_d", delta)
    total = lambda x: F.round(F.coalesce(F.sum(x), F.lit(0.0)), digits)
    grade = F.col("_d") / F.col("gap_m") * 100
    return at.groupBy("line").agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.min_by("z", "k"), digits).alias("start_m"),
        F.round(F.max_by("z", "k"), digits).alias("end_m"),
        F.round(F.min("z"), digits).alias("low_m"),
        F.round(F.max("z"), digits).alias("high_m"),
        total(F.greatest("_d", F.lit(0.0))).alias("ascent_m"),
        total(F.greatest(-F.col("_d"), F.lit(0.0))).alias("descent_m"),
        F.round(F.coalesce(F.max(grade), F.lit(0.0)), 2).alias("max_grade"),
        F.round(F.coalesce(F.min(grade), F.lit(0.0)), 2).alias("min_grade"),
    )


def project(vertices: DataFrame, lat: float, lng: float) -> DataFrame:
    """(line, pos, off_m, along_m): where each line passes a point nearest, on a local plane around the point.

    pos is the first vertex of the nearest segment (the first of equals); segments of no length are left out, and so are lines
    without any other.
    """
    x, y = (F.col("lng") - lng) * 111320.0 * F.cos(F.radians(F.lit(lat))), (F.col("lat") - lat) * 111320.0
    following = lambda c: F.lead(c).over(_along())
    at = vertices.withColumn("_x", x).withColumn("_y", y)
    spans = at.select("line", "pos", "_x", "_y", (following("_x") - F.col("_x")).alias("_dx"), (following("_y") - F.col("_y")).alias("_dy"))
    spans = spans.withColumn("_len", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    spans = spans.withColumn("_walked", F.coalesce(F.sum("_len").over(_along().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).filter("_len > 0")
    t = F.least(F.greatest(-(F.col("_x") * F.col("_dx") + F.col("_y") * F.col("_dy")) / (F.col("_len") * F.col("_len")), F.lit(0.0)), F.lit(1.0))
    spans = spans.withColumn("_t", t)
    off = F.round(F.sqrt(F.pow(F.col("_x") + F.col("_t") * F.col("_dx"), 2) + F.pow(F.col("_y") + F.col("_t") * F.col("_dy"), 2)), 3)
    best = spans.groupBy("line").agg(F.min(F.struct(off.alias("off_m"), "pos", F.round(F.col("_walked") + F.col("_len") * F.col("_t"), 3).alias("along_m"))).alias("best"))
    return best.select("line", "best.pos", "best.off_m", "best.along_m")


def surface_summary(segments: DataFrame) -> DataFrame:
    """(line, primary_surface, total_m, mix, access) of segments (line, pos, surface, steps, d, wheelchair, smoothness, sac).

    The main surface is the longest known one, the first seen on a tie, and unknown only if nothing else is there. mix lists all with their
    metres, by name; access is the accessibility ladder.
    """
    known = F.col("surface") != "unknown"
    parts = segments.groupBy("line", "surface").agg(F.sum("d").alias("m"), F.min("pos").alias("first"))
    main = F.coalesce(F.max_by(F.when(known, F.col("surface")), F.when(known, F.struct("m", -F.col("first")))), F.lit("unknown"))
    mix = F.array_sort(F.collect_list(F.concat_ws(" ", "surface", F.round("m", 1).cast("string"))))
    sums = parts.groupBy("line").agg(main.alias("primary_surface"), F.round(F.sum("m"), 3).alias("total_m"), F.array_join(mix, ", ").alias("mix"))
    access = segments.groupBy("line").agg(normalize.route_access(*(F.col(c) for c in ("steps", "wheelchair", "surface", "smoothness", "sac"))).alias("access"))
    return sums.join(access, "line")


def nearest_ranks(rows: DataFrame, by: str, value: str, quantiles: dict[str, float], *, bins: int = 4096) -> DataFrame:
    """(by, n, low, high, mean, <names>): nearest-rank quantiles, the value at rank ceil(q n), exact for groups of any size.

    A group's values fall into bins between its ends, whose counts are summed before the shuffle; only bins that hold a wanted rank are
    then ranked one by one. Nulls don't count.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    ends = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"))
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(0).cast("int")
    binned = rows.join(ends.withColumnRenamed("_by", "_of"), F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "_v", "n", place.alias("bin"))
    counts = binned.groupBy("_by", "bin", "n").agg(F.count(F.lit(1)).alias("held"))
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("_by").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).alias("rank")) for k, q in quantiles.items())))
    hit = counts.withColumn("w", wanted).filter((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("held")))
    hit = hit.select(F.col("_by").alias("_of"), F.col("bin").alias("_bin"), "w.name", (F.col("w.rank") - F.col("before")).alias("rank"))
    inside = binned.join(hit, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("bin") == F.col("_bin"))).select("_by", "name", "rank", "_v")
    ranked = inside.withColumn("at", F.row_number().over(W.partitionBy("_by", "name").orderBy("_v"))).filter("at = rank")
    found = ranked.groupBy(F.col("_by").alias("_of")).agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in quantiles))
    return ends.join(found, F.col("_by").eqNullSafe(F.col("_of"))).select(F.col("_by").alias(by), "n", "low", "high", "mean", *quantiles)


def without_repeats(vertices: DataFrame, value: str) -> DataFrame:
    """(line, <value>s): each line's values in order, equal ones in a row once."""
    before = F.lag(value).over(_along())
    kept = vertices.withColumn("_keep", ~F.col(value).eqNullSafe(before) | F.lag("pos").over(_along()).isNull()).filter("_keep")
    return kept.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias(f"{value}s"))


def sampled_climbs(vertices: DataFrame, metres: float) -> DataFrame:
    """(line, n_samples, ascent_m, descent_m) over the vertices that keep_every() keeps."""
    kept = vertices.select("line", F.col("pos").cast("bigint").alias("pos"), "z").join(keep_every(vertices, metres), ["line", "pos"])
    delta = F.coalesce(F.col("z") - F.lag("z").over(_along()), F.lit(0.0))
    at = kept.withColumn("_d", delta).groupBy("line")
    return at.agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum(F.greatest("_d", F.lit(0.0))), 1).alias("ascent_m"), F.round(F.sum(F.greatest(-F.col("_d"), F.lit(0.0))), 1).alias("descent_m"))


def numbered(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, 2, ... in a global order, without one task for all of them.

    Rows are range-partitioned and sorted; each partition's count gives the next one its first number.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # the position within a partition stands in the low 33 bits, the partition in the bits above
    parts = cut(parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row for each partition
    return parts.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def facet_filter(rows: DataFrame, describing: Sequence[str], text: str, facets: dict[str, str]) -> DataFrame:
    """Rows with the wanted value of every facet ('all' leaves one open) that hold a text anywhere in what describes them; no text, no condition."""
    needle = text.strip().lower()
    out = rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in describing))), F.lit(needle))) if needle else rows
    for name, wanted in facets.items():
        if wanted != "all":
            out = out.filter(F.col(name) == wanted)
    return out
