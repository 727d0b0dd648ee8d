"""Proximity and containment joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.sources.scratch import cut

#: Half of the earth's circumference: no two points are farther apart.
HALF_TURN_M = math.pi * geo.EARTH_RADIUS_M
#: Distances are rounded to millimetres before they are compared, so that cells have to be a little wider than the radius.
ROUNDED_M = 0.001
#: How often a radius is quartered at most, and the pairs of neighbouring cells that the first circles may make for each point that is looked for.
MOST_RINGS, PAIRS_PER_FOUND = 6, 16


def _columns_of(band: Column, metres: float, height: float) -> Column:
    """Into how many cells a band of latitude is cut: as many as leave each at least as wide as ``metres`` reach from or to this band."""
    reach = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * height + height, F.lit(90.0))
    share = F.lit(math.sin(min(metres / (2 * geo.EARTH_RADIUS_M), math.pi / 2))) / F.greatest(F.cos(F.radians(reach)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(share, F.lit(1.0))))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))


def within_radius(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of (id, lat, lng) points at most ``metres`` apart: (id, other, distance_m), distance rounded to millimetres.

    An equi-join on grid cells: bands of latitude as high as the radius, each cut into cells as wide as the radius is at the
    band's latitude, around the whole earth. The right side is copied into the nine cells around it (fewer near the poles),
    then the exact distance decides. Only points of neighbouring cells meet; points without coordinates meet none.
    """
    reach = metres + ROUNDED_M
    height = math.degrees(reach / geo.EARTH_RADIUS_M)
    band = F.floor(F.col("lat") / height)
    cell = lambda b: F.floor((geo.longitude(F.col("lng")) + 180) / 360 * _columns_of(b, reach, height))

    def around(step: int) -> Column:
        n = _columns_of(band + step, reach, height)
        return F.array_distinct(F.array(*(F.struct((band + step).alias("y"), F.pmod(cell(band + step) + i, n).alias("x")) for i in (-1, 0, 1))))

    near = right.select(F.col("id").alias("other"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.explode(F.concat(*(around(i) for i in (-1, 0, 1)))).alias("_c"))
    pairs = left.withColumn("_y", band).withColumn("_x", cell(band)).join(near.select("other", "o_lat", "o_lng", F.col("_c.y").alias("_y"), F.col("_c.x").alias("_x")), ["_y", "_x"])
    # most pairs of neighbouring cells are too far: that shows before roots and rounding
    square = geo.haversine_square(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))
    most = math.sin(min(reach / (2 * geo.EARTH_RADIUS_M), math.pi / 2)) ** 2 * (1 + 1e-9)
    near = pairs.filter((F.abs(F.col("lat") - F.col("o_lat")) <= height) & (square <= most)) if most < 1 else pairs
    distance = F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")), 3)
    return near.select("id", "other", distance.alias("distance_m")).filter(F.col("distance_m") <= metres)


def proximity_topk(left: DataFrame, right: DataFrame, metres: float, k: int, *, rings: int | None = None) -> DataFrame:
    """Each left point's ``k`` nearest right points within ``metres``, ties by id: (id, other, distance_m, rank). Left ids are unique.

    Small circles first: a point that has ``k`` within a quarter of the radius needs no wider search, as whatever lies beyond is farther.
    So where right points are dense, far fewer pairs are made than the whole radius holds. ``rings`` is how often the radius is quartered,
    by default as often as the points' density asks for. Points at one place are searched once, and of right ones there only the first ``k`` can count.
    """
    spots = cut(left.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng").agg(F.min("id").alias("id")).select("id", "lat", "lng"))
    first = right.withColumn("_n", F.row_number().over(W.partitionBy("lat", "lng").orderBy("id"))).filter(F.col("_n") <= k)
    first = cut(first.select("id", "lat", "lng"))
    rings = _rings_for(spots, first, metres, k) if rings is None else rings
    found, open_spots = None, spots
    for i in range(rings, -1, -1):
        ranked = within_radius(open_spots, first, metres / 4**i)
        by = W.partitionBy("id").orderBy("distance_m", "other")
        ranked = ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if i:
            full = ranked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id"))).filter(F.col("_n") == k).drop("_n")
            full = cut(full)
            open_spots = cut(open_spots.join(full.select("id").distinct(), "id", "left_anti"))
            ranked = full
        found = ranked if found is None else found.unionByName(ranked)
    found = spots.join(found, "id").drop("id")
    return left.select("id", "lat", "lng").join(found, ["lat", "lng"]).select("id", "other", "distance_m", "rank")


def _rings_for(left: DataFrame, right: DataFrame, metres: float, k: int) -> int:
    """The least number of times to quarter a radius after which cells as wide hold, around left points, about PAIRS_PER_FOUND pairs for each of ``k``."""
    side = lambda points, is_left: points.select("lat", "lng", F.lit(is_left).alias("l"))
    level = side(left, 1).unionByName(side(right, 0)).withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(MOST_RINGS))))
    height = F.lit(math.degrees(metres / geo.EARTH_RADIUS_M)) / F.pow(F.lit(4.0), F.col("ring"))
    cells = level.groupBy("ring", F.floor(F.col("lat") / height).alias("y"), F.floor(F.col("lng") / height).alias("x")).agg(F.sum("l").alias("l"), F.sum(1 - F.col("l")).alias("r"))
    per_ring = cells.groupBy("ring").agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.sum("l").alias("l")).collect()
    return min((r.ring for r in per_ring if 9 * r.pairs <= PAIRS_PER_FOUND * k * r.l), default=MOST_RINGS)


def nearest(points: DataFrame, places: DataFrame, within: float | None = None, *, start: float = 250.0) -> DataFrame:
    """``points`` (id, ...) with place and distance_m of the nearest of ``places`` (id, lat, lng), lower id on a tie; null beyond ``within``.

    Circles grow fourfold from ``start`` metres until every point has found a place, or reach ``within``. Ids are unique. Without places, or
    without coordinates, both are null. The fewer of the two are copied into the cells around them.
    """
    most, reach = min(within if within is not None else HALF_TURN_M, HALF_TURN_M), start
    left, found = points.select("id", "lat", "lng").filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()), None
    fewer = left.count() < places.count()
    while True:
        if fewer:
            pairs = within_radius(places, left, min(reach, most)).select(F.col("other").alias("id"), F.col("id").alias("other"), "distance_m")
        else:
            pairs = within_radius(left, places, min(reach, most))
        near = pairs.groupBy("id").agg(F.min(F.struct("distance_m", "other")).alias("near"))
        near = cut(near.select("id", F.col("near.other").alias("place"), F.col("near.distance_m").alias("distance_m")))
        found = near if found is None else found.unionByName(near)
        left = left.join(near.select("id"), "id", "left_anti")
        if reach >= most or left.isEmpty() or places.isEmpty():
            return points.join(found, "id", "left")
        reach *= 4


def contained(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Adds inside and boundary_m for a closed ring."""
    lat, lng = F.col("lat"), F.col("lng")
    return points.withColumn("inside", geo.in_ring(lat, lng, ring)).withColumn("boundary_m", F.round(geo.ring_distance(lat, lng, ring), 3))


def boundary_scope(a: tuple, b: tuple, ring: list[tuple[float, float]]) -> Column:
    """How the segment a-b of (lat, lng) columns lies to a closed ring: inside, crossing, or null."""
    a_in, b_in = geo.in_ring(*a, ring), geo.in_ring(*b, ring)
    return F.when(a_in & b_in, "inside").when(a_in | b_in | geo.crosses_ring(a, b, ring), "crossing")


def grid_clusters(points: DataFrame, cell: float, *, least: int = 22, most: int = 36) -> DataFrame:
    """Points by grid cell: (cell_y, cell_x, n, lat, lng, icon) with the members' mean place."""
    y, x = (F.floor(F.col(c) / F.lit(cell)).cast("long") for c in ("lat", "lng"))
    grouped = points.groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))
    return grouped.withColumn("icon", F.least(F.lit(most), (least + F.round(F.log2(F.col("n") + 1) * 2)).cast("int")))


def bounds(points: DataFrame, *by: str, pad: float = 0.0) -> DataFrame:
    """(by, south, west, north, east): the box around points of each group, wider by a share ``pad`` of its sides; null coordinates don't count."""
    box = points.groupBy(*by).agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))
    dy, dx = (F.col("north") - F.col("south")) * pad, (F.col("east") - F.col("west")) * pad
    return box.select(*by, (F.col("south") - dy).alias("south"), (F.col("west") - dx).alias("west"), (F.col("north") + dy).alias("north"), (F.col("east") + dx).alias("east"))


def with_near(points: DataFrame, places: DataFrame, metres: float, *, out: str = "near") -> DataFrame:
    """Adds ``out``: the places (id, lat, lng) within ``metres`` as a sorted array of (distance_m, place), empty where none is.

    Places are gathered by grid cell, each in the nine cells that it can be near to, and points look their own cell up: one left join,
    which streams can do too. For places of bounded density; points of any number, with any columns and repeated ids.
    """
    reach = metres + ROUNDED_M
    height = math.degrees(reach / geo.EARTH_RADIUS_M)
    band = F.floor(F.col("lat") / height)
    cell = lambda b: F.floor((geo.longitude(F.col("lng")) + 180) / 360 * _columns_of(b, reach, height))

    def around(step: int) -> Column:
        n = _columns_of(band + step, reach, height)
        return F.array_distinct(F.array(*(F.struct((band + step).alias("y"), F.pmod(cell(band + step) + i, n).alias("x")) for i in (-1, 0, 1))))

    dealt = places.select("id", "lat", "lng", F.explode(F.concat(*(around(i) for i in (-1, 0, 1)))).alias("_c"))
    held = dealt.groupBy(F.col("_c.y").alias("_near_y"), F.col("_c.x").alias("_near_x")).agg(F.collect_list(F.struct("id", "lat", "lng")).alias("_held"))
    at = points.withColumn("_y", band).withColumn("_x", cell(band)).join(held, (F.col("_y") == F.col("_near_y")) & (F.col("_x") == F.col("_near_x")), "left")
    measured = F.transform(F.coalesce("_held", F.array()), lambda p: F.struct(F.round(geo.haversine(F.col("lat"), F.col("lng"), p["lat"], p["lng"]), 3).alias("distance_m"), p["id"].alias("place")))
    return at.withColumn(out, F.array_sort(F.filter(measured, lambda p: p["distance_m"] <= metres))).drop("_y", "_x", "_near_y", "_near_x", "_held")


def along_line(lat: Column, lng: Column, line: list[tuple[float, float]]) -> Column:
    """Where a fixed line of (lat, lng) passes a point nearest, on a local plane around the point: (off_m, index, along_m, length_m).

    index is the segment's, the first of equally near ones; segments of no length are left out. Null for a line without any other.
    """
    east = F.cos(F.radians(lat)) * geo.LOCAL_LNG_M
    xy = [((F.lit(b) - lng) * east, (F.lit(a) - lat) * geo.LOCAL_LNG_M) for a, b in line]
    walked, spots = F.lit(0.0), []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(xy, xy[1:])):
        if line[i] == line[i + 1]:
            continue
        dx, dy = bx - ax, by - ay
        length = F.sqrt(dx * dx + dy * dy)
        t = geo.clamp(-(ax * dx + ay * dy) / (length * length), 0.0, 1.0)
        off = F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))
        spots.append(F.struct(off.alias("off_m"), F.lit(i).alias("index"), (walked + length * t).alias("along_m")))
        walked = walked + length
    if not spots:
        return F.lit(None).cast("struct<off_m:double,index:int,along_m:double,length_m:double>")
    best = F.array_min(F.array(*spots))
    return F.struct(best["off_m"].alias("off_m"), best["index"].alias("index"), best["along_m"].alias("along_m"), walked.alias("length_m"))
