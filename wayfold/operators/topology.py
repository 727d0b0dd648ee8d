"""From ways and nodes to a routable topology: scope, policy, meaningful nodes and the chains between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo, normalize
from wayfold.operators import contracts, spatial

#: Node tags that a path must not be joined across.
RELEVANT_TAGS = ("access", "barrier", "crossing", "entrance", "foot", "highway", "wheelchair")
#: Why a node stands in the topology, in the order of report.
REASONS = ("route_projection_node", "network_degree_not_two", "multiple_source_ways", "source_node_tag_transition", "selected_way_run_endpoint", "boundary_crossing_endpoint")


def has_relevant_tag(tags: Column) -> Column:
    """Whether a tag map has one of RELEVANT_TAGS."""
    return F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, RELEVANT_TAGS)))


def adjacencies(ways: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Pairs of nodes next to each other on a way that lie in a ring or cross it: (way, index, a, b, scope, reason, block, metres).

    ``ways`` is (way, pos, node, highway, foot, access), ``nodes`` (node, lat, lng, foot, access). reason is the way's policy, block why
    one of the nodes can't be passed (the first one's reason first). Pairs with a node that isn't there are left out.
    """
    known = nodes.select("node", "lat", "lng", normalize.node_block(F.col("foot"), F.col("access")).alias("closed"), F.lit(True).alias("there"))
    at = ways.join(known, "node", "left").withColumn("reason", normalize.pedestrian_policy(F.col("highway"), F.col("foot"), F.col("access")))
    by = W.partitionBy("way").orderBy("pos")
    following = lambda c: F.lead(c).over(by)
    pairs = at.select("way", F.col("pos").alias("index"), F.col("node").alias("a"), "lat", "lng", "closed", "there", "reason", following("node").alias("b"), following("lat").alias("b_lat"), following("lng").alias("b_lng"), following("closed").alias("b_closed"), following("there").alias("b_there"))
    pairs = pairs.filter("there and b_there")
    scope = spatial.boundary_scope((F.col("lat"), F.col("lng")), (F.col("b_lat"), F.col("b_lng")), ring)
    metres = F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng")), 3)
    out = pairs.select("way", "index", "a", "b", scope.alias("scope"), "reason", F.coalesce("closed", "b_closed").alias("block"), metres.alias("metres"))
    return out.filter("scope is not null")


def admitted(pairs: DataFrame) -> DataFrame:
    """The pairs that pedestrians may walk."""
    return pairs.filter("reason = 'included' and block is null")


def with_runs(pairs: DataFrame) -> DataFrame:
    """Adds run: pairs of a way with consecutive indexes share one, so that what was left out is never bridged; and whether a pair is its run's first or last."""
    by = W.partitionBy("way").orderBy("index")
    out = pairs.withColumn("run", F.col("index") - F.row_number().over(by))
    inside = W.partitionBy("way", "run").orderBy("index")
    return out.withColumn("first", F.lag("index").over(inside).isNull()).withColumn("last", F.lead("index").over(inside).isNull())


def meaningful_nodes(pairs: DataFrame, nodes: DataFrame, route_nodes: DataFrame) -> DataFrame:
    """(node, degree, n_ways, reasons) for every node of the admitted ``pairs`` (as with_runs() gives them): why it stands in the topology.

    ``nodes`` is (node, tagged), whether it has a relevant tag, ``route_nodes`` (node) those that routes already use. reasons is an
    array in the order of REASONS, empty for a node that only passes a path on.
    """
    end = lambda n, edge: pairs.select(F.col(n).alias("node"), "way", F.col(edge).alias("run_end"), (F.col("scope") == "crossing").alias("crossing"))
    ends = end("a", "first").unionByName(end("b", "last"))
    at = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("way").alias("n_ways"), F.bool_or("run_end").alias("run_end"), F.bool_or("crossing").alias("crossing"))
    at = at.join(nodes.select("node", "tagged"), "node", "left").join(route_nodes.select("node", F.lit(True).alias("routed")).distinct(), "node", "left")
    why = (F.col("routed"), F.col("degree") != 2, F.col("n_ways") > 1, F.col("tagged"), F.col("run_end"), F.col("crossing"))
    return at.select("node", "degree", "n_ways", F.array_compact(F.array(*(F.when(w, F.lit(name)) for w, name in zip(why, REASONS)))).alias("reasons"))


def chains(pairs: DataFrame, meaningful: DataFrame) -> DataFrame:
    """(id, way, from_node, to_node, n_pairs, metres, scopes): each run cut at its meaningful nodes; neighbouring chains share the node between them.

    ``meaningful`` is (node). A chain's id is made of its way, its ends and a digest of its nodes in order.
    """
    stops = meaningful.select(F.col("node").alias("a"), F.lit(1).alias("stop")).distinct()
    at = pairs.join(stops, "a", "left")
    inside = W.partitionBy("way", "run").orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("chain", F.sum(F.coalesce("stop", F.lit(0))).over(inside))
    # a chain's nodes are a part of one way's
    whole = at.groupBy("way", "run", "chain").agg(F.array_sort(F.collect_list(F.struct("index", "a", "b"))).alias("p"), F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("metres"), 3).alias("metres"), F.concat_ws(" ", F.array_sort(F.collect_set("scope"))).alias("scopes"))
    first, last = F.get("p", F.lit(0))["a"], F.element_at("p", -1)["b"]
    nodes = F.concat(F.transform("p", lambda x: x["a"].cast("string")), F.array(last.cast("string")))
    name = F.concat_ws("", F.lit("pathseg-way-"), "way", F.lit("-"), first, F.lit("--"), last, F.lit("-"), F.substring(F.sha1(F.array_join(nodes, "/")), 1, 10))
    return whole.select(name.alias("id"), "way", first.alias("from_node"), last.alias("to_node"), "n_pairs", "metres", "scopes")


def merged_scope(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, src, dst, metres, origin, reverse_id): segments (id, src, dst, metres) of an old topology and a wider new one.

    What the old one has stays; a new segment between the same nodes with the same length is the same one and is left out. Each is
    wired to the segment that leads back over the same length, the least id of several; null on a one-way.
    """
    both = old.select("id", "src", "dst", "metres", F.lit(0).alias("o")).unionByName(new.select("id", "src", "dst", "metres", F.lit(1).alias("o")))
    same = W.partitionBy("src", "dst", "metres").orderBy("o", "id")
    kept = both.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metres", F.col("id").alias("reverse_id")).filter("src <> dst")
    first = back.groupBy("src", "dst", "metres").agg(F.min("reverse_id").alias("reverse_id"))
    return kept.join(first, ["src", "dst", "metres"], "left").select("id", "src", "dst", "metres", F.when(F.col("o") == 0, "old").otherwise("new").alias("origin"), "reverse_id")


def chain_checks(runs: DataFrame, nodes: DataFrame, made: DataFrame) -> DataFrame:
    """contracts.checks() of chains() ``made`` from runs and nodes, re-derived from these: names, lengths and ends of chains, inner nodes, degrees, reasons, and that
    every pair is in one chain and no run bridges a gap."""
    stops = nodes.filter(F.size("reasons") > 0)
    ends = made.select(F.col("from_node").alias("node")).union(made.select("to_node"))
    counted = runs.select(F.col("a").alias("node")).union(runs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    whole = made.groupBy("way").agg(F.sum("n_pairs").alias("n")).join(runs.groupBy("way").agg(F.count(F.lit(1)).alias("m")), "way", "full")
    gaps = runs.groupBy("way", "run").agg((F.max("index") - F.min("index") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    known = F.array(*map(F.lit, REASONS))
    ids = lambda rows, c: rows.select(F.col(c).alias("id"))
    return contracts.checks({
        "chain_ids_unique": made.groupBy("id").count().filter("count > 1").select("id"),
        "chains_have_length": made.filter("n_pairs < 1 or metres < 0").select("id"),
        "chain_ends_meaningful": ids(ends.join(stops, "node", "left_anti"), "node"),
        "inner_nodes_pass_on": ids(nodes.filter(F.size("reasons") == 0).filter("degree <> 2 or n_ways <> 1"), "node"),
        "pairs_covered_once": ids(whole.filter("not n <=> m"), "way"),
        "scopes_known": ids(runs.filter("scope not in ('inside', 'crossing')"), "way"),
        "degrees_match": ids(nodes.join(counted, "node", "full").filter("not degree <=> n"), "node"),
        "reasons_known": ids(nodes.filter(F.size(F.array_except("reasons", known)) > 0), "node"),
        "runs_never_bridge": ids(gaps.filter("span <> n"), "way"),
    })
