"""Weighted-field search ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.normalize import fold_text, match_tier, terrain_direction
from wayfold.operators import spatial

#: What a field adds to its match tier (exact 0, prefix 1, contained 2), and the score of an empty query.
FIELD_BASE = {"title": 0, "facets": 3, "keywords": 7, "body": 20}
EMPTY_SCORE = 50


def score(needle: str, title: Column, facets: list[Column], keywords: list[Column], body: list[Column]) -> Column:
    """The best score over all fields, null if none matches."""
    wanted = fold_text(F.lit(needle))
    if not needle.strip():
        return F.lit(EMPTY_SCORE)
    tiers = [match_tier(fold_text(f), wanted) + base for group, base in (([title], 0), (facets, 3), (keywords, 7), (body, 20)) for f in group]
    return F.least(*tiers) if len(tiers) > 1 else tiers[0]


def rank(index: DataFrame, matched: Column, *, order: list[Column], limit: int) -> DataFrame:
    """The ``limit`` best rows with their score and the number of all matches."""
    hits = index.withColumn("score", matched).filter(F.col("score").isNotNull())
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    # total is one row
    return hits.orderBy("score", *order).limit(limit).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def incident(relations: DataFrame) -> DataFrame:
    """(entity, relation, other, kind) from either end; a loop counts at both."""
    end = F.explode(F.array(F.struct(F.col("src").alias("entity"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity"), F.col("src").alias("other"))))
    return relations.withColumn("_end", end).select("_end.entity", "id", "_end.other", "kind")


def journey(relations: DataFrame, ranks: dict[str, int], limit: int = 8) -> DataFrame:
    """Each entity's next stops: its other ends once each (the first relation by id wins), by the relation's rank, then id."""
    first = W.partitionBy("entity", "other").orderBy("id")
    stops = incident(relations).filter("entity <> other").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    kinds = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    by = W.partitionBy("entity").orderBy(F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(99)), "id", "other")
    return stops.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)


def best_match(needle: str, title: Column, facets: list[tuple[Column, str]], keywords: list[Column], body: list[Column]) -> Column:
    """(score, label) of the best field: the label is the winning facet's, else null; of equal scores the field named first wins. Null without a match."""
    wanted = fold_text(F.lit(needle))
    none = F.lit(None).cast("string")
    if not needle.strip():
        return F.struct(F.lit(EMPTY_SCORE).alias("score"), none.alias("label"))
    fields = [(title, 0, None), *((f, 3, label) for f, label in facets), *((f, 7, None) for f in keywords), *((f, 20, None) for f in body)]
    tries = F.array(*(F.struct((match_tier(fold_text(f), wanted) + base).alias("score"), F.lit(i).alias("nth"), (none if label is None else F.lit(label)).alias("label")) for i, (f, base, label) in enumerate(fields)))
    best = F.array_min(F.filter(tries, lambda x: x["score"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["score"].alias("score"), best["label"].alias("label")))


def route_options(edges: DataFrame, targets: DataFrame, *, sort: str = "time", only: str | None = None, limit: int = 8) -> DataFrame:
    """Each node's outgoing edges ranked: (src, id, dst, affordances, place). ``edges`` is (id, src, dst, minutes, distance, ascent, descent, delta),
    ``targets`` (node, viewpoint, heritage, water_axis). Edges to an unknown target are dropped.

    By the metric of ``sort`` (time, distance, ascent, descent; any other counts as time), then time, distance, id; an unknown metric comes last. ``only`` keeps
    edges with that affordance, before the limit.
    """
    metric = {"distance": "distance", "ascent": "ascent", "descent": "descent"}.get(sort, "minutes")
    at = edges.join(targets.withColumnRenamed("node", "dst"), "dst")
    way = terrain_direction(F.col("delta"))
    flags = [F.lit("nearby"), F.when(way.isin("uphill", "downhill"), way), F.when(F.col("viewpoint"), "viewpoint"), F.when(F.col("water_axis"), "water-axis"), F.when(F.col("heritage"), "heritage")]
    at = at.withColumn("affordances", F.array_compact(F.array(*flags)))
    if only is not None:
        at = at.filter(F.array_contains("affordances", only))
    by = W.partitionBy("src").orderBy(*(F.asc_nulls_last(c) for c in (metric, "minutes", "distance")), "id")
    return at.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit).select("src", "id", "dst", "affordances", "place")


def network_index(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, kind, title, context, keywords) of a walking network: junctions, nodes (node, neighbours) with three neighbours or more, and
    segments (id, src, dst, distance_m, steps, surface, highway, accessibility_status)."""
    junction = nodes.filter("neighbours >= 3").select(F.concat(F.lit("node-"), F.col("node").cast("string")).alias("id"), F.lit("junction").alias("kind"), F.lit("Path junction").alias("title"), F.concat(F.col("neighbours").cast("string"), F.lit(" connections")).alias("context"), F.lit("junction kreuzung").alias("keywords"))
    steps = F.coalesce("steps", F.lit(False))
    metres = F.concat(F.floor(F.col("distance_m") + 0.5).cast("string"), F.lit(" m"))
    path = segments.select("id", F.when(steps, "steps").otherwise("path").alias("kind"), F.when(steps, "Mapped steps").otherwise("Mapped path segment").alias("title"), F.concat_ws(" · ", F.coalesce("highway", F.lit("path")), F.coalesce("surface", F.lit("surface unknown")), metres).alias("context"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "surface", "highway", "accessibility_status").alias("keywords"))
    return junction.unionByName(path)


def search_network(index: DataFrame, query: str, kind: str = "all", limit: int = 40) -> DataFrame:
    """The first ``limit`` rows of network_index() that hold ``query`` anywhere, junctions before steps before paths, then by id, with the number of all."""
    needle = query.strip().lower()
    hay = F.lower(F.concat_ws(" ", "id", "title", "context", "keywords"))
    hits = index.filter(F.contains(hay, F.lit(needle)) if needle else F.lit(True))
    if kind in ("junction", "steps", "path"):
        hits = hits.filter(F.col("kind") == kind)
    order = F.when(F.col("kind") == "junction", 0).when(F.col("kind") == "steps", 1).otherwise(2)
    total = hits.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_one"))
    # total is one row
    return hits.orderBy(order, "id").limit(limit).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def last_by_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Of rows with one key the last by ordinal, in the place of the first: what a map keeps when keys are set again."""
    held = F.max_by(F.struct(*(c for c in rows.columns if c not in key and c != ordinal)), ordinal)
    return rows.groupBy(*key).agg(held.alias("_row"), F.min(ordinal).alias(ordinal)).select(*key, "_row.*", ordinal)


def nearby(origins: DataFrame, entries: DataFrame, *, radius: float = 250.0, limit: int = 6, categories: tuple[str, ...] = ("place", "tree", "feature")) -> DataFrame:
    """(id, other, distance_m, rank): each origin's nearest entries of some categories within a radius, itself left out.

    ``origins`` is (id, lat, lng), ``entries`` (id, category, lat, lng); an entry of the origin's own id is the origin.
    """
    some = entries.filter(F.col("category").isin(*categories))
    pairs = spatial.within_radius(origins.select("id", "lat", "lng"), some.select("id", "lat", "lng"), radius).filter("id <> other")
    by = W.partitionBy("id").orderBy("distance_m", "other")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def related(relations: DataFrame, ranks: dict[str, int], options: DataFrame, limit: int = 8) -> DataFrame:
    """Each entity's related stops: (entity, other, kind, place). Relations first, then direct walks; a stop comes once, as the first that names it.

    ``relations`` is (id, src, dst, kind), ``options`` route_options() rows. Order: the relation's rank, walks 100, then id or place.
    """
    kinds = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    rank = F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(99))
    semantic = incident(relations).filter("entity <> other").select("entity", "other", "kind", rank.alias("r"), F.lit(0).alias("source"), F.lit(0).alias("nth"), F.col("id").alias("key"))
    walks = options.select(F.col("src").alias("entity"), F.col("dst").alias("other"), F.lit("nearby").alias("kind"), F.lit(100).alias("r"), F.lit(1).alias("source"), F.col("place").alias("nth"), F.col("id").alias("key")).filter("entity <> other")
    both = semantic.unionByName(walks)
    first = W.partitionBy("entity", "other").orderBy("source", "nth", "key")
    once = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    by = W.partitionBy("entity").orderBy("r", "nth", "key", "other")
    return once.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit).select("entity", "other", "kind", "place")
