"""Domain shapes over the driver's tables: points, polylines, edges, tags and position fixes.

A shape is a list of SQL expressions that Spark and DuckDB read alike, so that both sides of a comparison start from the same rows; what
is compared are the operators on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.layers import table

#: A closed ring of (lat, lng).
RING = [(51.309, 9.389), (51.321, 9.392), (51.3215, 9.405), (51.318, 9.421), (51.3105, 9.4225), (51.308, 9.407), (51.309, 9.389)]


def _at(key: str, a: int, b: int) -> list[str]:
    return [f"(51307000 + ({key} * {a}) % 16000) / 1e6 lat", f"(9385000 + ({key} * {b}) % 40000) / 1e6 lng"]


_SHAPES: dict[str, tuple[str, list[str]]] = {
    "customers": ("customer", ["c_custkey id", *_at("c_custkey", 7919, 10007)]),
    "suppliers": ("supplier", ["s_suppkey id", *_at("s_suppkey", 6007, 9973)]),
    # every nation is a place
    "places": ("nation", ["cast(n_nationkey as bigint) id", *_at("n_nationkey", 6007, 9973)]),
    # every part is a map node
    "nodes": ("part", ["p_partkey node", *_at("p_partkey", 7919, 10007), "case p_partkey % 29 when 0 then 'no' when 1 then 'yes' end foot", "case p_partkey % 31 when 0 then 'private' when 1 then 'no' when 2 then 'yes' end access", "case p_partkey % 17 when 0 then 'gate' when 1 then 'stile' end barrier", "200 + p_size * 1.5e0 z"]),
    # every part is a way's tags as well
    "tags": (
        "part",
        [
            "p_partkey id",
            "case p_size % 6 when 0 then 'footway' when 1 then 'path' when 2 then 'steps' when 3 then 'motorway' when 4 then 'track' end highway",
            "case p_partkey % 5 when 0 then 'yes' when 1 then 'no' when 2 then 'designated' end foot",
            "case p_partkey % 3 when 0 then 'private' when 1 then 'no' end access",
            "case p_partkey % 7 when 0 then 'asphalt' when 1 then 'gravel' when 2 then 'mud' when 3 then 'grass' when 4 then 'sett' when 5 then 'marble' end surface",
            "case p_partkey % 13 when 0 then 'up' when 1 then 'DOWN' when 2 then '12%' when 3 then '-7%' when 4 then 'steep' when 5 then '7.5%' when 6 then '12' when 7 then '' when 8 then '-0.25' when 9 then '1234567' when 10 then 'up%' end incline",
            "case p_partkey % 4 when 0 then 'forward' when 1 then 'reverse' when 2 then 'both' end direction",
            "case p_partkey % 8 when 0 then 'stile' when 1 then 'gate' when 2 then 'turnstile' end barrier",
            "case when p_partkey % 11 = 0 then concat(' ', p_size, ',5 ') when p_partkey % 11 = 1 then 'n/a' else cast(p_size as varchar(9)) end width",
            "case p_partkey % 9 when 0 then 'yes' when 1 then ' -1' when 2 then 'no' when 3 then 'REVERSE' when 4 then 'maybe' end oneway_foot",
            "case p_partkey % 10 when 0 then '1' when 1 then 'false' end foot_oneway",
            "case p_partkey % 6 when 0 then 'forward' when 1 then 'backward' when 2 then 'yes' end conveying",
            "case p_partkey % 6 when 0 then 'no' when 1 then 'limited' end wheelchair",
            "case p_partkey % 12 when 0 then 'bad' when 1 then 'good' when 2 then 'horrible' end smoothness",
            "case p_partkey % 14 when 0 then 'hiking' when 1 then '' end sac_scale",
        ],
    ),
    "fixes": (
        "events",
        [
            "user_id",
            "event_id",
            "ts",
            "(51307000 + (((user_id + event_id % 3) % 25) * 6007) % 16000) / 1e6 + (cast(round(value * 100) as bigint) % 6000) / 100e0 / 111320e0 lat",
            "(9385000 + (((user_id + event_id % 3) % 25) * 9973) % 40000) / 1e6 lng",
            "case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 17 = 0 then 60e0 else cast(regexp_extract(props, '([0-9]+)', 1) as int) / 4e0 end accuracy",
        ],
    ),
    # every part is a cell of an elevation grid with 50 columns
    "raster": ("part", ["cast(floor(p_partkey / 50e0) as bigint) row", "p_partkey % 50 col", "215e0 + p_size * 3 z"]),
}

_LINES = [
    "l_orderkey line",
    "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) pos",
    "l_partkey node",
    *_at("l_partkey", 7919, 10007),
    "200 + l_quantity * 5 z",
    "case l_returnflag when 'A' then 'paved' when 'N' then 'gravel' when 'R' then case when l_linenumber % 2 = 0 then 'dirt' end end surface",
    "l_linestatus = 'F' steps",
    "l_quantity * 2 d",
]
_SHAPES["polylines"] = ("lineitem", _LINES)

#: Edges of three families over all parts, destinations modulo the number of parts.
_EDGES = ["concat(fam, '-', src, '-', dst) id", "src", "dst", "cast(p_size * 10 + src % 7 as bigint) w", "p_size % 4 = 0 steps", "p_size"]
_FAMILIES = [("p_size % 5 <> 0", "(p_partkey * 7 + 3) % {n}", "a"), ("p_size % 3 = 0", "(p_partkey + 1) % {n}", "b"), ("p_partkey % 2 = 0", "(p_partkey * 3 + 11) % {n}", "c")]

#: Directed segments of a walking network: each edge, and its reverse unless it is one-way.
_SEGMENT = [
    "case when back then concat(id, '-r') else id end id",
    "case when back then dst else src end src",
    "case when back then src else dst end dst",
    "cast(w as double) distance_m",
    "case p_size % 4 when 0 then true when 1 then false end steps",
    "case when w >= 90 then case when back then p_size % 5 else p_size % 9 end * 1e0 end ascent_m",
    "case when w >= 90 then case when back then p_size % 9 else p_size % 5 end * 1e0 end descent_m",
    "case src % 6 when 0 then 'paved' when 1 then 'gravel' when 2 then 'dirt' when 3 then 'grass' else 'unknown' end surface",
    "src % 23 <> 0 eligible",
    "case src % 37 when 0 then 'no' when 1 then 'yes' end foot",
    "case src % 19 when 0 then 'private' when 1 then 'no' end access",
    "case dst % 41 when 0 then 'no' when 1 then 'yes' end gate_foot",
    "case dst % 43 when 0 then 'private' end gate_access",
    "case dst % 11 when 0 then 'stile' when 1 then 'gate' end barrier",
    "case when src % 13 = 0 then 'no' end wheelchair",
    "case when p_size % 7 = 0 then 'forward' else 'both' end oneway",
    "back",
]


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _SHAPES[name]
    return table(spark, sf_dir, source).selectExpr(*(c.replace("varchar(9)", "string") for c in columns))


def sql(name: str) -> str:
    source, columns = _SHAPES[name]
    return f"(select {', '.join(columns)} from {source})"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "customers")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "suppliers")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "places")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, pos, node, lat, lng, z, surface, steps, d): a polyline for each order, a vertex for each item.

    Numbered before anything is renamed, so that what goes by line later lies as the numbering left it.
    """
    number, rest = _LINES[1].removesuffix(" pos"), [c for c in _LINES if c != _LINES[1]]
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.expr(number)).selectExpr(rest[0], "pos", *rest[1:])


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, ts, lat, lng, accuracy): a position fix for each event."""
    return shape(spark, sf_dir, "fixes")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def n_nodes(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count()


def _edges_with_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, n = table(spark, sf_dir, "part").select("p_partkey", "p_size"), n_nodes(spark, sf_dir)
    families = [part.filter(where).selectExpr("p_partkey src", f"{to.format(n=n)} dst", f"'{fam}' fam", "p_size") for where, to, fam in _FAMILIES]
    return reduce(DataFrame.union, families).selectExpr(*_EDGES)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, src, dst, w, steps): three families of edges over every part."""
    return _edges_with_size(spark, sf_dir).drop("p_size")


_N = "(select count(*) from part)"
_EDGE_ROWS = " union all ".join(f"select p_partkey src, {to.format(n=_N)} dst, '{fam}' fam, p_size from part where {where}" for where, to, fam in _FAMILIES)
EDGES = f"(select {', '.join(_EDGES)} from ({_EDGE_ROWS}))"
SEGMENTS = f"(select {', '.join(_SEGMENT)} from (select *, false back from {EDGES} union all select *, true from {EDGES} where p_size % 7 <> 0))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed segments (id, src, dst, distance_m, steps, ascent_m, descent_m, surface, eligible, foot, access, gate_foot, gate_access, barrier, wheelchair)."""
    edges = _edges_with_size(spark, sf_dir)
    both = edges.withColumn("back", F.lit(False)).unionByName(edges.filter("p_size % 7 <> 0").withColumn("back", F.lit(True)))
    return both.selectExpr(*_SEGMENT)
