"""Graph operators on edge tables (src, dst, ...): states are DataFrames, a round is one join and one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.sources.scratch import cut

#: Rounds between two cuts of the lineage: each cut costs a write, each round more makes the plan longer.
ROUNDS_PER_CUT = 3
#: Rounds of a search between two looks at which pairs are done; the share of a root's open labels that a round extends; rows of open labels up to
#: which those of a round are broadcast; the share of a sum that rounding may have added, far more than it ever does.
ROUNDS_PER_CHECK, FRONT_SHARE, FRONT_ROWS, ROUNDING = 2, 0.5, 200_000, 1e-9


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; the reverse row swaps ascent and descent and changes the sign of delta and grade, where they exist."""
    swap = {"src": "dst", "dst": "src"} | ({"ascent": "descent", "descent": "ascent"} if {"ascent", "descent"} <= set(edges.columns) else {})
    turned = lambda c: -F.col(c) if c in ("delta", "grade") else F.col(swap.get(c, c))
    return edges.unionByName(edges.select(*(turned(c).alias(c) for c in edges.columns)))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node within reach over undirected edges; isolated nodes are their own.

    Labels spread along edges and then jump to their label's label, so that long chains take few rounds.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = kept = cut(nodes.select(F.col("node"), F.col("node").alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("label"))
        jump = spread.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = cut(spread.join(jump, F.col("label") == F.col("to"), "left").select("node", F.least("label", F.coalesce("far", "label")).alias("component"), F.col("component").alias("old")), instead_of=kept)
        labels, kept = new.select("node", "component"), new
        if new.filter("component <> old").isEmpty():
            return labels


def component_sizes(labels: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(component, component_id, size, n_edges): members of each component, the edges within it, and a name that its members decide.

    The name digests the members' number, the least of them and the sum of their own digests, so no component's members are gathered.
    """
    digest = F.sum(F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 8), 16, 10).cast("long"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"), digest.alias("digest"))
    name = F.concat(F.lit("pathcomponent-"), F.substring(F.sha1(F.concat_ws("/", "component", "size", "digest")), 1, 12))
    sizes = sizes.select("component", name.alias("component_id"), "size")
    if edges is None:
        return sizes
    inside = edges.join(labels, F.col("src") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    return sizes.join(inside, "component", "left").select("component", "component_id", "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def _to_fixpoint(state: DataFrame, keys: list[str], extend: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` (keys, label) with the least labels that repeated extension reaches.

    ``extend`` maps (keys, label) of rows changed in the round before to candidates of the same columns. Candidates and state
    meet in one aggregate; where the least label is a candidate's, the row counts as changed. Ends when a round changes none.
    """
    now = kept = cut(state.select(*keys, "label", F.lit(True).alias("changed")))
    while True:
        for _ in range(ROUNDS_PER_CUT):
            candidates = extend(now.filter("changed").select(*keys, "label"))
            both = now.select(*keys, F.struct("label", F.lit(0).alias("new")).alias("x")).unionByName(candidates.select(*keys, F.struct("label", F.lit(1).alias("new")).alias("x")))
            now = both.groupBy(*keys).agg(F.min("x").alias("x")).select(*keys, "x.label", (F.col("x.new") == 1).alias("changed"))
        now = kept = cut(now, instead_of=kept)
        if now.filter("changed").isEmpty():
            return now.select(*keys, "label")


def shortest(edges: DataFrame, source: int, cost: list[Column]) -> DataFrame:
    """(node, cost, hops, parent) of least paths from ``source`` over directed edges.

    ``cost`` lists non-negative edge costs, compared lexicographically and summed along the path; ties go to fewer hops, then to the
    smaller parent. Each round relaxes the edges that leave nodes improved in the round before, until a round improves none.
    """
    n = len(cost)
    steps = cut(edges.select("src", "dst", F.struct(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(cost))).alias("w")))
    zero = F.struct(*(F.lit(0.0).alias(f"c{i}") for i in range(n)), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent"))
    start = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), zero.alias("label"))

    def extend(front: DataFrame) -> DataFrame:
        label = F.struct(*((F.col(f"label.c{i}") + F.col(f"w.c{i}")).alias(f"c{i}") for i in range(n)), (F.col("label.hops") + 1).alias("hops"), F.col("src").cast("long").alias("parent"))
        return front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").cast("long").alias("node"), label.alias("label"))

    best = _to_fixpoint(start, ["node"], extend)
    return best.select("node", *(F.col(f"label.c{i}").alias(f"cost_{i}") for i in range(n)), F.col("label.hops").alias("hops"), F.col("label.parent").alias("parent"))


def least_routes(segments: DataFrame, pairs: DataFrame, cost: list[Column], *, paths: bool = True) -> DataFrame:
    """(origin, node, cost, path): the least route of each of ``pairs`` (origin, node) that has one, over directed segments (id, src, dst, ...).

    cost is an array of sums, compared element by element, of non-negative costs; ties go to the lexicographically smaller array of segment ids,
    path (null without ``paths``). Two balls around the ends of a pair grow until they hold every route that is as short as the least, so of a
    large network only what lies around the ends is searched. Paths are carried only within them and along routes that can still be least.
    """
    steps = cut(segments.select("id", "src", "dst", F.array(*(c.cast("double") for c in cost)).alias("w")))
    # sums of whole numbers are exact; the first cost that isn't whole decides up to rounding, so that nothing after it may be relied on
    parts = [F.get("w", F.lit(i)) for i in range(len(cost))]
    whole = steps.agg(*(F.coalesce(F.bool_and(x == F.floor(x)) & (F.sum(x) < 2.0**53), F.lit(True)) for x in parts)).first()
    depth = next((i + 1 for i, x in enumerate(whole) if not x), len(cost))
    exact = all(whole)
    head = lambda a: F.slice(a, 1, depth)
    state, pairs = _balls(steps.select("src", "dst", head("w").alias("w")), pairs.select("origin", "node").distinct(), depth, exact)
    found = pairs.filter("best is not null")
    if exact and not paths:
        return found.select("origin", "node", F.col("best").alias("cost"), F.lit(None).cast("array<string>").alias("path"))

    near, far = _ball(state, 0, "origin", "src", "f"), _ball(state, 1, "node", "dst", "b")
    inside = lambda label, least: F.col(label).isNotNull() & (F.col(least).isNull() | (F.col(label) < F.col(least)))
    rest = F.least("b", "to_least")
    can_be_least = lambda so_far: _lowered(_sum(so_far, "rest"), depth, exact) <= F.col("best")
    out_of = found.join(near, "origin").filter(inside("f", "from_least")).join(steps, "src").join(far, ["node", "dst"], "left")
    into = found.join(far, "node").filter(inside("b", "to_least")).join(steps, "dst").join(near, ["origin", "src"], "left").filter(~inside("f", "from_least"))
    columns = ["origin", "src", "dst", "id", "w", "f", "from_least", "best", rest.alias("rest")]
    kept = out_of.select(*columns).unionByName(into.select(*columns)).filter(can_be_least(_sum(F.least("f", "from_least"), head("w"))))
    kept = cut(kept.select("origin", "src", "dst", "id", "w", "best", "rest"))

    none = F.array().cast("array<string>")
    start = found.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.struct(F.array(*[F.lit(0.0)] * len(cost)).alias("cost"), none.alias("path")).alias("label"))

    def extend(front: DataFrame) -> DataFrame:
        label = F.struct(_sum("label.cost", "w").alias("cost"), F.concat("label.path", F.array("id")).alias("path"))
        at = front.withColumnRenamed("node", "src").join(kept, ["origin", "src"]).select("origin", F.col("dst").alias("node"), label.alias("label"), "rest", "best")
        return at.filter(can_be_least(head("label.cost"))).select("origin", "node", "label")

    best = _to_fixpoint(start, ["origin", "node"], extend)
    return found.select("origin", "node").join(best, ["origin", "node"]).select("origin", "node", "label.cost", "label.path")


def _sum(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _lowered(total: Column, depth: int, exact: bool) -> Column:
    """``total`` without what rounding may have added to its last element."""
    if exact:
        return total
    return F.transform(total, lambda x, i: F.when(i == depth - 1, x * (1 - ROUNDING)).otherwise(x))


def _ball(state: DataFrame, side: int, root: str, node: str, label: str) -> DataFrame:
    return state.filter(F.col("side") == side).select(F.col("root").alias(root), F.col("node").alias(node), F.col("label").alias(label))


def _balls(steps: DataFrame, pairs: DataFrame, depth: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Balls around both ends of ``pairs`` (origin, node) over directed steps (src, dst, w), as large as the pairs' least costs need.

    Gives (side, root, node, label, open), side 0 from origins and 1 back from nodes, and (origin, node, best, from_least, to_least): the least cost, null
    if there is no route, and how far each side's labels are final: a label below is least, and what has none below isn't nearer. Null: all are.

    A round extends the lower share of each root's open labels. What is open bounds what isn't found yet: a pair is done when the least open
    labels of its sides sum up to more than the best meeting, or a side has none left.
    """
    both = cut(steps.select(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("to"), "w").unionByName(steps.select(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("to"), "w")))
    none = F.lit(None).cast("array<double>")
    ends = lambda p: p.select(F.lit(0).alias("side"), F.col("origin").alias("root")).unionByName(p.select(F.lit(1).alias("side"), F.col("node").alias("root"))).distinct()
    state = cut(ends(pairs).select("side", "root", F.col("root").alias("node"), F.array(*[F.lit(0.0)] * depth).alias("label"), F.lit(True).alias("open")))
    pairs = cut(pairs.select("origin", "node", none.alias("best"), none.alias("from_least"), none.alias("to_least"), F.lit(False).alias("done")))
    while True:
        active = ends(pairs.filter("not done"))
        for _ in range(ROUNDS_PER_CHECK):
            opened = state.filter("open").join(active, ["side", "root"], "left_semi")
            limits = _lower_share(opened.select("side", "root", "label"), depth)
            front = state.filter("open").join(limits, ["side", "root"]).filter("label <= limit").select("side", "root", "node", "label")
            # of a known number of rows
            front = F.broadcast(front) if state.filter("open").count() <= FRONT_ROWS else front
            reached = both.join(front, ["side", "node"]).select("side", "root", F.col("to").alias("node"), F.struct(_sum("label", "w").alias("label"), F.lit(1).alias("new"), F.lit(True).alias("open")).alias("x"))
            still = F.col("open") & ~F.coalesce(F.col("label") <= F.col("limit"), F.lit(False))
            before = state.join(limits, ["side", "root"], "left").select("side", "root", "node", F.struct("label", F.lit(0).alias("new"), still.alias("open")).alias("x"))
            state = cut(before.unionByName(reached).groupBy("side", "root", "node").agg(F.min("x").alias("x")).select("side", "root", "node", "x.label", "x.open"), instead_of=state)
        least = state.filter("open").groupBy("side", "root").agg(F.min("label").alias("least"))
        of = lambda side, root, name: least.filter(F.col("side") == side).select(F.col("root").alias(root), F.col("least").alias(name))
        left = pairs.filter("not done").select("origin", "node")
        met = left.join(_ball(state, 0, "origin", "at", "f"), "origin").join(_ball(state, 1, "node", "at", "b"), ["node", "at"]).groupBy("origin", "node").agg(F.min(_sum("f", "b")).alias("best"))
        left = left.join(met, ["origin", "node"], "left").join(of(0, "origin", "from_least"), "origin", "left").join(of(1, "node", "to_least"), "node", "left")
        done = F.col("from_least").isNull() | F.col("to_least").isNull() | F.coalesce(_lowered(_sum("from_least", "to_least"), depth, exact) > F.col("best"), F.lit(False))
        pairs = cut(pairs.filter("done").unionByName(left.withColumn("done", done)), instead_of=pairs)
        if pairs.filter("not done").isEmpty():
            return state, pairs.drop("done")


def _lower_share(labels: DataFrame, depth: int) -> DataFrame:
    """(side, root, limit): the label up to which about FRONT_SHARE of a root's labels (side, root, label) lie, the least of them always."""
    out = None
    for i in range(depth):
        at = labels if out is None else labels.join(out, ["side", "root"]).filter(F.slice("label", 1, i) == F.col("limit"))
        next_part = at.groupBy("side", "root").agg(F.percentile_approx(F.get("label", F.lit(i)), FRONT_SHARE).alias("part"))
        out = next_part.select("side", "root", F.array("part").alias("limit")) if out is None else out.join(next_part, ["side", "root"]).select("side", "root", F.array_append("limit", F.col("part")).alias("limit"))
    return out


def route(tree: DataFrame, target: int) -> DataFrame:
    """(position, node) of the path to ``target`` in a shortest() tree, position counted from the source.

    Pointers to parents are doubled: a round finds as many further nodes as are known, so a path of n steps takes log n rounds.
    """
    up = cut(tree.filter("parent is not null").select("node", F.col("parent").alias("up")))
    found = cut(tree.filter(F.col("node") == target).select("node"))
    while True:
        more = cut(found.join(up, "node").select(F.col("up").alias("node")))
        if more.isEmpty():
            return tree.join(found, "node").select(F.col("hops").alias("position"), "node")
        found = cut(found.unionByName(more), instead_of=found)
        up = cut(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")), instead_of=up)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours, junction): edge ends, distinct neighbours, and whether these are three or more."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    out = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("neighbours"))
    return out.withColumn("junction", F.col("neighbours") >= 3)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming): sorted lists of edge ids by end; a node with edges of one kind only has an empty list of the other."""
    ends = edges.select(F.col("src").alias("node"), F.col("id").alias("out"), F.lit(None).cast("string").alias("in")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("out"), F.col("id").alias("in")))
    return ends.groupBy("node").agg(F.array_sort(F.collect_list("out")).alias("outgoing"), F.array_sort(F.collect_list("in")).alias("incoming"))


def first_by_pair(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each unordered pair of ends: the first by ``order``."""
    by = W.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(order)
    return edges.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def minimum_spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w, id) of the least spanning forest, ties by id.

    Every component takes its cheapest way out, until none is left. The ways chosen in a round point from component to component, and two that
    point at each other are one edge, of which the smaller component becomes a root; pointers jump to their pointers until all reach one.
    """
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    edges = cut(edges.select("src", "dst", "w", "id"))
    taken = None
    while True:
        placed = edges.join(labels.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a <> b")
        # what lies within a component is never needed again
        edges = cut(placed.select("src", "dst", "w", "id", "a", "b"))
        ways = edges.unionByName(edges.select("src", "dst", "w", "id", F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = cut(ways.groupBy("a").agg(F.min(F.struct("w", "id", "src", "dst", "b")).alias("e")).select("a", "e.*"))
        edges = edges.select("src", "dst", "w", "id")
        if chosen.isEmpty():
            return taken if taken is not None else edges.limit(0)
        new = chosen.select("src", "dst", "w", "id").distinct()
        taken = cut(new if taken is None else taken.unionByName(new))
        facing = chosen.select(F.col("a").alias("b"), F.col("id").alias("back"))
        root = (F.col("back") == F.col("id")) & (F.col("a") < F.col("b"))
        pointers = chosen.join(facing, "b").select("a", F.when(root, F.col("a")).otherwise(F.col("b")).alias("to"))
        labels = cut(labels.join(_jumped(pointers), F.col("component") == F.col("a"), "left").select("node", F.coalesce("to", "component").alias("component")))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(a, to) with every pointer moved to the root that it leads to; a root points at itself."""
    pointers = cut(pointers)
    while True:
        now = pointers
        for _ in range(2):  # each doubles the plan
            now = now.join(now.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        now = cut(now.join(pointers.withColumnRenamed("to", "before"), "a"))
        pointers = now.select("a", "to")
        if now.filter("to <> before").isEmpty():
            return pointers


def nearest_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Of unordered pairs (a, b, w) those that are among the ``k`` least of one of their ends, ties by pair."""
    ends = pairs.select(F.col("a").alias("end"), "a", "b", "w").unionByName(pairs.select(F.col("b").alias("end"), "a", "b", "w"))
    ranked = ends.withColumn("_n", F.row_number().over(W.partitionBy("end").orderBy("w", "a", "b"))).filter(F.col("_n") <= k)
    return ranked.select("a", "b", "w").distinct()


def chains(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(chain, n_edges, w): edges (id, src, dst, w) joined up through nodes with exactly two neighbours that aren't in ``keep`` (node).

    Such nodes only pass a path on. A chain is named by its least inner node; an edge between two other nodes is a chain by its id.
    One edge is taken for each unordered pair; loops are left out.
    """
    single = cut(first_by_pair(edges.filter("src <> dst"), "id"))
    inner = degrees(single).filter("neighbours = 2").select("node")
    inner = cut(inner if keep is None else inner.join(keep.select("node"), "node", "left_anti"))
    inside = single.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
    labels = components(inner, inside)
    at = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_chain"))
    placed = single.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    name = F.coalesce(F.col("src_chain").cast("string"), F.col("dst_chain").cast("string"), F.col("id"))
    return placed.groupBy(name.alias("chain")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"))
