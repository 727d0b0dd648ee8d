"""Walking routes: policies over segment facts, batches of requests, typed outcomes and evidence.

Facts are never turned into claims: what a route says of its accessibility is negative evidence or unknown, whatever a policy prefers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import normalize
from wayfold.operators import contracts, graph
from wayfold.sources.scratch import cut

#: Fixed value: what a metre of unknown ascent weighs in the ascent score, never in a route's facts.
UNKNOWN_ASCENT_WEIGHT = 0.10
UNKNOWN_STATUSES = ("unknown_not_field_verified", "unknown_unmapped_connector")


def _ascent_score() -> Column:
    return F.coalesce(F.col("ascent_m"), F.col("distance_m") * UNKNOWN_ASCENT_WEIGHT)


#: Soft policies: costs of a segment, compared one after the other.
POLICIES = {
    "shortest": lambda: [F.col("distance_m")],
    "avoid_known_steps_lower_ascent": lambda: [F.when(F.col("steps"), F.col("distance_m")).otherwise(F.lit(0.0)), _ascent_score(), F.col("distance_m")],
}
#: Profiles of the published network: whether known steps are ruled out.
PROFILES = {"shortest": False, "avoid-mapped-steps": True}


def admissible(segments: DataFrame) -> DataFrame:
    """Segments that may be walked, by their own tags and their barriers' (an array column of (foot, access, barrier))."""
    return segments.filter(normalize.segment_allowed(*(F.col(c) for c in ("eligible", "foot", "access", "barriers"))))


def resolve(requests: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Adds ``column``_node for an endpoint's name: a node's own id, else its place's, else its map node's; null if it names nothing.

    ``names`` is (name, node, rank); of several nodes for one name the one with the least rank, then the least id, counts.
    """
    best = names.groupBy(F.col("name").alias(column)).agg(F.min(F.struct("rank", "node")).alias("_n"))
    return requests.join(best, column, "left").withColumn(f"{column}_node", F.col("_n.node")).drop("_n")


def routes(segments: DataFrame, requests: DataFrame, policy: str) -> DataFrame:
    """(request, from_node, to_node, outcome, cost, path) for ``requests`` (request, from_node, to_node) under a soft policy.

    outcome is ok, unknown-endpoint or no-route; a route from a node to itself is ok with no segments. Only segments that may be walked are
    used. Each pair of ends is searched once, however many requests share it.
    """
    known = F.col("from_node").isNotNull() & F.col("to_node").isNotNull()
    pairs = requests.filter(known).select(F.col("from_node").alias("origin"), F.col("to_node").alias("node"))
    found = graph.least_routes(admissible(segments), pairs, POLICIES[policy]())
    return _outcomes(requests, found)


def routes_under(segments: DataFrame, requests: DataFrame, policies: list[str]) -> DataFrame:
    """(policy, ...) and what routes() gives for each of ``policies``, all searched in the same rounds; a cost has as many elements as the longest, the rest 0.

    Every policy has a copy of the network to itself, whose nodes are named (policy, node).
    """
    costs = {p: POLICIES[p]() for p in policies}
    most = max(map(len, costs.values()))
    usable, wide = cut(admissible(segments).select("id", "src", "dst", *(F.array(*c, *[F.lit(0.0)] * (most - len(c))).alias(f"_{i}") for i, c in enumerate(costs.values())))), None
    for i in range(len(policies)):
        own = usable.select("id", *(F.struct(F.lit(i).alias("policy"), F.col(end).alias("node")).alias(end) for end in ("src", "dst")), F.col(f"_{i}").alias("w"))
        wide = own if wide is None else wide.unionByName(own)
    asked = requests.withColumn("policy", F.explode(F.array(*map(F.lit, range(len(policies))))))
    pairs = asked.filter("from_node is not null and to_node is not null").select(*(F.struct("policy", F.col(c).alias("node")).alias(to) for c, to in (("from_node", "origin"), ("to_node", "node"))))
    found = graph.least_routes(wide, pairs, [F.get("w", F.lit(i)) for i in range(most)])
    found = found.select(F.col("origin.policy").alias("policy"), F.col("origin.node").alias("origin"), F.col("node.node").alias("node"), "cost", "path")
    names = F.element_at(F.array(*map(F.lit, policies)), F.col("policy") + 1)
    return _outcomes(asked, found, "policy").withColumn("policy", names)


def _outcomes(requests: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    found = found.withColumnRenamed("origin", "from_node").withColumnRenamed("node", "to_node")
    out = requests.join(found, [*by, "from_node", "to_node"], "left")
    known = F.col("from_node").isNotNull() & F.col("to_node").isNotNull()
    outcome = F.when(~known, "unknown-endpoint").when(F.col("path").isNull(), "no-route").otherwise("ok")
    return out.select(*by, "request", "from_node", "to_node", outcome.alias("outcome"), "cost", "path")


def evidence(found: DataFrame, segments: DataFrame) -> DataFrame:
    """What a route is made of, for routes with outcome ok: (request, n_segments, distance_m, known_ascent_m, known_descent_m,
    terrain_unknown_m, known_step_m, unknown_access_m, negative_evidence, accessibility_status)."""
    legs = found.filter("outcome = 'ok'").select("request", F.explode_outer("path").alias("id")).join(segments, "id", "left")
    total = lambda x, digits: F.round(F.coalesce(F.sum(x), F.lit(0.0)), digits)
    d = F.col("distance_m")
    negative = F.array_sort(F.collect_set(F.when(F.startswith("accessibility_status", F.lit("known_")), F.col("accessibility_status"))))
    out = legs.groupBy("request").agg(
        F.count("id").alias("n_segments"),
        total(d, 2).alias("distance_m"),
        total(F.col("ascent_m"), 1).alias("known_ascent_m"),
        total(F.col("descent_m"), 1).alias("known_descent_m"),
        total(F.when(F.col("ascent_m").isNull(), d), 2).alias("terrain_unknown_m"),
        total(F.when(F.col("steps"), d), 2).alias("known_step_m"),
        total(F.when(F.col("accessibility_status").isin(*UNKNOWN_STATUSES), d), 2).alias("unknown_access_m"),
        negative.alias("negative"),
    )
    status = F.when(F.size("negative") > 0, "known_negative_accessibility_evidence").otherwise("unknown_not_an_accessibility_claim")
    return out.withColumn("negative_evidence", F.concat_ws(" ", "negative")).withColumn("accessibility_status", status).drop("negative")


def plan_walks(network: DataFrame, anchors: DataFrame, requests: DataFrame, profile: str) -> DataFrame:
    """(request, outcome, distance_m, path) over the published network, with an outcome that says what is missing.

    Segments are walked both ways unless one-way, known steps are ruled out by the profile, the shortest route wins. ``anchors`` is (place, node,
    component), ``requests`` (request, from_place, to_place). Outcomes, the first that holds: unknown-profile, same-place, unknown-source-anchor,
    unknown-destination-anchor, disconnected-components, no-route-for-profile, ok. What can't succeed is never searched.
    """
    at = lambda end: anchors.select(F.col("place").alias(f"{end}_place"), F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_component"))
    asked = requests.join(at("from"), "from_place", "left").join(at("to"), "to_place", "left")
    early = F.when(F.lit(profile not in PROFILES), "unknown-profile").when(F.col("from_place") == F.col("to_place"), "same-place").when(F.col("from_node").isNull(), "unknown-source-anchor")
    early = early.when(F.col("to_node").isNull(), "unknown-destination-anchor").when(F.col("from_component") != F.col("to_component"), "disconnected-components")
    asked = cut(asked.withColumn("early", early))
    usable = network.filter(normalize.network_segment_allowed(F.col("eligible"), F.col("distance_m"), F.col("steps"), without_steps=PROFILES.get(profile, False)))
    legs = usable.select("id", "src", "dst", "distance_m").unionByName(usable.filter("coalesce(oneway, 'both') = 'both'").select(F.concat(F.lit("-"), "id").alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "distance_m"))
    found = graph.least_routes(legs, asked.filter("early is null").select(F.col("from_node").alias("origin"), F.col("to_node").alias("node")), [F.col("distance_m")])
    out = asked.join(found.withColumnRenamed("origin", "from_node").withColumnRenamed("node", "to_node"), ["from_node", "to_node"], "left")
    outcome = F.coalesce("early", F.when(F.col("path").isNull(), "no-route-for-profile").otherwise("ok"))
    ok = F.col("outcome") == "ok"
    return out.withColumn("outcome", outcome).select("request", "outcome", F.when(ok, F.get("cost", F.lit(0))).alias("distance_m"), F.when(ok, F.col("path")).alias("path"))


def walk_evidence(found: DataFrame, network: DataFrame) -> DataFrame:
    """Counts and metres along planned walks: (request, surfaces, step_segments, step_m, step_unknown_segments, constraint_segments, unverified_segments, endpoint_m)."""
    legs = found.filter("outcome = 'ok'").select("request", F.explode("path").alias("leg")).select("request", F.regexp_replace("leg", "^-", "").alias("id")).join(network, "id")
    surface = F.coalesce(F.nullif("surface", F.lit("")), F.lit("unknown"))
    by_surface = legs.groupBy("request", surface.alias("s")).agg(F.sum("distance_m").alias("m")).groupBy("request").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "s", F.round("m", 1).cast("string")))), ", ").alias("surfaces"))
    status = F.col("accessibility_status")
    sums = legs.groupBy("request").agg(
        F.count_if(F.col("steps")).alias("step_segments"),
        F.coalesce(F.sum(F.when(F.col("steps"), F.col("distance_m"))), F.lit(0.0)).alias("step_m"),
        F.count_if(F.col("steps").isNull()).alias("step_unknown_segments"),
        F.count_if(status == "known_barrier_mobility_constraint").alias("constraint_segments"),
        F.count_if(F.startswith(status, F.lit("unknown"))).alias("unverified_segments"),
        F.coalesce(F.sum(F.when(status == "unknown_unmapped_connector", F.col("distance_m"))), F.lit(0.0)).alias("endpoint_m"),
    )
    return by_surface.join(sums, "request")


def stitched(found: DataFrame, network: DataFrame) -> DataFrame:
    """(request, coordinates) of planned walks: their segments' coordinate arrays end to end, turned where walked backwards, each joint once."""
    legs = found.filter("outcome = 'ok'").select("request", F.posexplode("path").alias("nth", "leg"))
    legs = legs.withColumn("id", F.regexp_replace("leg", "^-", "")).join(network.select("id", "coordinates"), "id").filter(F.size("coordinates") > 0)
    own = F.when(F.startswith("leg", F.lit("-")), F.reverse("coordinates")).otherwise(F.col("coordinates"))
    parts = legs.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("nth", own.alias("c")))).alias("parts"))
    return parts.select("request", F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["c"]).otherwise(F.slice(p["c"], 2, F.size(p["c"]))))).alias("coordinates"))


def pairwise(edges: DataFrame, snapped: DataFrame) -> DataFrame:
    """(a, b, net_m, total_m) for each pair of places a < b with a route over undirected edges (id, src, dst, w) between the nodes that they
    were snapped to (place, node, snap_m); total_m includes the way to and from the network."""
    both = edges.select("id", "src", "dst", "w").union(edges.select("id", "dst", "src", "w"))
    a = snapped.select(F.col("place").alias("a"), F.col("node").alias("origin"), F.col("snap_m").alias("a_m"))
    b = snapped.select(F.col("place").alias("b"), "node", F.col("snap_m").alias("b_m"))
    asked = cut(a.join(b, F.col("a") < F.col("b")))
    reached = graph.least_routes(both, asked.select("origin", "node"), [F.col("w")], paths=False)
    pairs = asked.join(reached, ["origin", "node"])
    net = F.get("cost", F.lit(0))
    return pairs.select("a", "b", net.alias("net_m"), F.round(F.col("a_m") + net + F.col("b_m"), 3).alias("total_m"))


def place_anchors(nodes: DataFrame) -> DataFrame:
    """(place, node): each place's first path node, from nodes (node, places), nodes in order of their id."""
    named = nodes.select("node", F.explode("places").alias("place"))
    return named.groupBy("place").agg(F.min("node").alias("node"))


def ranked_pairs(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Pairs (a, b, w) that are among the ``k`` shortest of one of their places, or in the least spanning forest over all pairs: (a, b, w, near, backbone)."""
    named = pairs.select("a", "b", "w", F.concat_ws("--", F.format_string("%020d", "a"), F.format_string("%020d", "b")).alias("id"))
    places = named.select(F.col("a").alias("node")).union(named.select("b")).distinct()
    tree = graph.minimum_spanning_forest(places, named.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w", "id")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("backbone"))
    near = graph.nearest_pairs(pairs, k).select("a", "b", F.lit(True).alias("near"))
    out = pairs.join(near, ["a", "b"], "left").join(tree, ["a", "b"], "left").filter("near or backbone")
    return out.select("a", "b", "w", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("backbone", F.lit(False)).alias("backbone"))


def first_by_ordinal(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each key, the first by ordinal."""
    by = W.partitionBy(key).orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def route_checks(soft: DataFrame, hard: DataFrame, one: DataFrame, again: DataFrame, soft_facts: DataFrame, hard_facts: DataFrame, allowed: DataFrame) -> DataFrame:
    """contracts.checks() of routes() that avoid steps and of the shortest, with their facts (request, step_m, distance_m): both find the same requests, neither is
    worse in what it is about, segments are admissible, and ``one`` and ``again``, two runs of the same search, agree."""
    facts = lambda r, name: r.select("request", F.col("step_m").alias(f"{name}_step"), F.col("distance_m").alias(f"{name}_m"))
    both = facts(soft_facts, "soft").join(facts(hard_facts, "hard"), "request")
    outcome = soft.select("request", "outcome", "from_node", "to_node", "path").join(hard.select("request", F.col("outcome").alias("other")), "request")
    used = soft.filter("outcome = 'ok'").select("request", F.explode("path").alias("id")).join(allowed.select("id"), "id", "left_anti")
    ids = lambda rows: rows.select(F.col("request").alias("id"))
    return contracts.checks({
        "routes_found_by_both_policies": ids(outcome.filter("outcome <> other")),
        "policy_never_worsens_steps": ids(both.filter("soft_step > hard_step")),
        "shortest_is_shortest": ids(both.filter("hard_m > soft_m")),
        "segments_are_admissible": ids(used),
        "same_endpoint_is_zero": ids(outcome.filter("from_node = to_node and (outcome <> 'ok' or size(path) > 0)")),
        "unknown_endpoint_fails_closed": ids(outcome.filter("(from_node is null or to_node is null) <> (outcome = 'unknown-endpoint')")),
        "reversed_input_changes_nothing": ids(one.join(again.select("request", F.col("path").alias("p")), "request").filter("not path <=> p")),
    })
