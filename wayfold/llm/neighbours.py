"""Largest inner products by collision-counting hashing.

A block of vectors is put on the unit sphere with one more coordinate, so that the largest inner product with a query is the least distance to it. Each of
``PROJECTIONS`` random directions gives the block a sorted array. Around a query's own place in every array a window opens; virtual rehashing widens all windows
together, radius by radius, and only what a window gains is counted. A vector that has collided in enough arrays is verified by its exact
inner product. The search of a block ends when the windows suit the radius of the k-th best found: what is nearer would have collided
often enough with a probability of 0.95. If they come to hold everything, the search is exact.

Equal vectors are one entry of the index with their smallest ids, and equal queries are searched once. Blocks hold vectors of similar
norms; queries meet blocks in groups, so that neither side of a task grows with the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.storage import materialize

#: Sorted arrays, and half a window's width at radius 1.
PROJECTIONS, HALF_WIDTH = 64, 0.7
#: How many standard deviations below a near vector's expected collisions the threshold lies: it misses one in twenty.
MARGIN = 1.645
#: Radii of virtual rehashing, closer together where the distances of most vectors of many components lie; at last everything.
RADII = np.concatenate([2.0 ** np.arange(-2, -0.5, 0.5), 2.0 ** np.arange(-0.5, 0.6, 0.125), [2.0, np.inf]])
#: Distinct vectors of a block and queries of a group: the two sides of a task.
BLOCK, GROUP = 1 << 14, 1 << 10
#: Tasks of the search, where the session's shuffles have no more; a task then takes several pairs of block and group, one after another.
MOST_TASKS = 1 << 13
#: Norms of a block differ by this factor at most.
BAND = 2.0


def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, margin: float = MARGIN) -> int:
    """Collisions that a vector at the windows' radius reaches with near certainty."""
    p = math.erf(half_width / math.sqrt(2))
    return max(1, math.floor(projections * (p - margin * math.sqrt(p * (1 - p) / projections))))


class Index(NamedTuple):
    vectors: np.ndarray
    scale: float  #: the largest norm
    directions: np.ndarray
    values: np.ndarray  #: each direction's sorted projections
    order: np.ndarray  #: the vectors in that order


def build(vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 1) -> Index:
    """Sorted arrays of projections of ``vectors`` (none zero), scaled to norms of at most 1 and lifted onto the sphere."""
    directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
    norm = np.linalg.norm(vectors, axis=1)
    scale = float(norm.max())
    lift = np.sqrt(np.maximum(1 - (norm / scale) ** 2, 0))
    projected = (vectors / scale) @ directions[:-1] + lift[:, None] * directions[-1]
    order = np.argsort(projected.T, axis=1, kind="stable")
    return Index(vectors, scale, directions, np.take_along_axis(projected.T, order, 1), order)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last in double precision."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def search(index: Index, queries: np.ndarray, k: int, need: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (none zero) the numbers and products of its at least k nearest verified vectors, or all if there are fewer."""
    n, (m, _) = len(index.vectors), index.values.shape
    need = threshold(m) if need is None else need
    radii = HALF_WIDTH * RADII
    size = np.linalg.norm(queries, axis=1)
    centre = (queries / size[:, None]) @ index.directions[:-1]
    first = 0  # windows open a little below the radius at which the query before ended
    for base in range(0, len(queries), 256):
        c = centre[base : base + 256]
        low, high = np.empty((len(radii), len(c), m), np.int64), np.empty((len(radii), len(c), m), np.int64)
        for i in range(m):
            low[:, :, i] = np.searchsorted(index.values[i], (c[None, :, i] - radii[:, None]).ravel(), "left").reshape(len(radii), -1)
            high[:, :, i] = np.searchsorted(index.values[i], (c[None, :, i] + radii[:, None]).ravel(), "right").reshape(len(radii), -1)
        for j in range(len(c)):
            query, norm = queries[base + j], size[base + j]
            seen, verified = np.zeros(n, np.int64), np.zeros(n, bool)
            found, product = np.zeros(0, np.int64), np.zeros(0)
            a = b = low[first, j]
            for r, radius in enumerate(RADII[first:], first):
                lo, hi = low[r, j], high[r, j]
                gained = [index.order[i, x:y] for i in range(m) for x, y in ((lo[i], a[i]), (b[i], hi[i])) if x < y]
                a, b = lo, hi
                if gained:
                    seen += np.bincount(np.concatenate(gained), minlength=n)
                fresh = np.flatnonzero((seen >= need) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    found = np.append(found, fresh)
                    product = np.append(product, np.einsum("ij,j->i", index.vectors[fresh], query))
                if len(found) >= min(k, n):
                    kth = np.partition(product, len(product) - min(k, n))[len(product) - min(k, n)]
                    if radius * radius >= 2 - 2 * kth / (norm * index.scale):
                        # what ties with the k-th but for the last bits stays, so that only the exact sums decide
                        found = found[product >= kth - 1e-9 * norm * index.scale]
                        first = max(0, r - 2)
                        break
            yield found, products(index.vectors[found], query)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector can be searched, with a digest of the vector and the band of its norm; negative zeros become zeros."""
    for batch in batches:
        lists = batch.column("vector")
        offsets, filled = lists.offsets.to_numpy().astype(np.int64), lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null becomes NaN
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        bad, solid = sums(~np.isfinite(values)), sums(values != 0)
        keep = np.flatnonzero(filled & (bad[offsets[1:]] == bad[offsets[:-1]]) & (solid[offsets[1:]] > solid[offsets[:-1]]))
        if not len(keep):
            continue
        parts = [values[offsets[i] : offsets[i + 1]] for i in keep]
        norm = np.array([np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max() for x in parts])
        clean = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
        keys = pa.array([hashlib.md5(x.tobytes()).digest() for x in parts], pa.binary())
        take = pa.array(keep)
        band = pa.array(np.floor(np.log2(norm) / math.log2(BAND) + 1e-6).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(take), clean, batch.column("asks").take(take), keys, band], ["id", "vector", "asks", "key", "band"])


def _search_block(k: int, projections: int):
    schema = pa.schema([pa.field("query", pa.binary()), pa.field("vec_id", pa.int64()), pa.field("score", pa.float64())])

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        lists = table.column(name).combine_chunks()
        return lists.flatten().to_numpy().reshape(len(lists), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("first")  # whatever order the shuffle brought
        ids = left.column("ids").combine_chunks()
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        query, vec_id, score = [], [], []
        for q, (found, product) in enumerate(search(build(matrix(left, "vector"), projections), matrix(right, "vector"), k)):
            n = offsets[found + 1] - offsets[found]
            which = np.repeat(offsets[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows, values = flat[which], np.repeat(product, n)
            best = np.lexsort((rows, -values))[:k]
            query.append(np.full(len(best), q))
            vec_id.append(rows[best])
            score.append(values[best])
        keys = right.column("key").combine_chunks().take(pa.array(np.concatenate(query)))
        return pa.Table.from_arrays([keys, pa.array(np.concatenate(vec_id)), pa.array(np.concatenate(score))], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", projections: int = PROJECTIONS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner products for each row of ``vectors`` that the condition ``is_query`` holds for.

    Candidates are all rows but the query's own; ranks start at 1, ties go to smaller ids. Rows with a null id, and vectors that are null, empty, zero or hold a
    null or non-finite component take no part. Vectors meet only those of their own length. A repeated id is as many rows; queries that repeat
    a row repeat its answer. Fewer than k candidates are all returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows.filter("id is not null").mapInArrow(_usable, "id bigint, vector array<double>, asks boolean, key binary, band int"), "vectors", keep=True)

    # one more than k, as a query's own row is among them; the limit also holds before the shuffle, so that a much repeated vector doesn't meet in one task
    few = rows.select("key", "id", "vector", "band").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id"))).filter(F.col("n") <= k + 1)
    index = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vector").alias("vector"), F.any_value("band").alias("band"))
    index = materialize(index.select("key", "ids", F.element_at("ids", 1).alias("first"), "vector", F.size("vector").alias("length"), "band"), "index", keep=True)
    asked = rows.filter("asks").groupBy("key").agg(F.any_value("vector").alias("vector")).withColumn("length", F.size("vector"))

    # a row for each length and band of norms, of which there are few whatever the input
    sizes = index.groupBy("length", "band").agg(F.count(F.lit(1)).alias("n")).collect()
    plan, spans, at = [], {}, 0
    for s in sorted(sizes, key=lambda s: (s.length, s.band)):
        n = -(-s.n // block)
        plan.append((s.length, s.band, at, n))
        spans[s.length] = (spans.get(s.length, (at,))[0], at + n - 1)
        at += n
    groups = max(1, -(-asked.count() // group))
    plan = F.broadcast(spark.createDataFrame(plan, "length int, band int, base int, blocks int"))
    spans = F.broadcast(spark.createDataFrame([(n, *s) for n, s in spans.items()], "length int, lo int, hi int"))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "key"), n).cast("int")
    entries = index.join(plan, ["length", "band"]).withColumn("block", F.col("base") + spread(F.col("blocks"), 3))
    entries = entries.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "first", "ids", "vector")
    askers = asked.join(spans, "length").withColumn("group", spread(F.lit(groups), 4)).select(F.explode(F.sequence("lo", "hi")).alias("block"), "group", "key", "vector")
    # few bytes mean much work here, so the number of tasks goes by pairs of block and group
    tasks = min(2 * at * groups, max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    entries, askers = (x.repartition(max(tasks, 1), "block", "group") for x in (entries, askers))
    best = entries.groupBy("block", "group").cogroup(askers.groupBy("block", "group")).applyInArrow(_search_block(k + 1, projections), "query binary, vec_id bigint, score double")
    ranked = best.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    answers = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("answers"))

    # a query's own row goes once, wherever it stands
    told = rows.filter("asks").select("id", "key").join(answers, F.col("key") == F.col("query"))
    own = F.array_position(F.col("answers.vec_id"), F.col("id"))
    others = F.filter("answers", lambda x, i: (own == 0) | (i != own.cast("int") - 1))
    told = told.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "answer"))
    return told.select("query_id", (F.col("at") + 1).alias("rank"), F.col("answer.vec_id").alias("vec_id"), F.col("answer.score").alias("score"))
