"""Weighted rendezvous hashing: every record draws a number for each shard and goes to the shard with the best draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of the digest of key and shard; SQL engines agree on it."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: the least -ln(draw) / weight, the lower shard on a tie.

    Only the key, and each shard's own number and weight, enter a draw: a further shard takes rows only into itself,
    a shard's removal moves only its own rows, and a shard gets rows in proportion to its weight. A null key
    counts as the empty string.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return _best(F.coalesce(key.cast("string"), F.lit("")), weights).getField("shard")


def _cost(key: Column, shard: int, weight: float) -> Column:
    return -F.ln(_draw(key, shard)) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of the best draw."""
    return F.array_min(F.array(*(F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights))))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", *, grown: float | None = None, grown_out: str = "grown_shard") -> DataFrame:
    """Adds (or replaces) the column ``out`` with each row's shard; no shuffle, all other columns stay.

    With ``grown``, the weight of one more shard, also ``grown_out`` with the shard that the row would have with it: the old one or
    the new, which only one more draw decides. Repeated keys share a shard; an empty table stays empty.
    """
    if grown is None:
        return df.withColumn(out, shard_of(F.col(key), weights))
    if not weights or min(*weights, grown) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best, new = _best(text, weights), _cost(text, len(weights), grown)
    with_best = df.withColumn("_best", best)
    with_best = with_best.withColumn(out, F.col("_best.shard"))
    return with_best.withColumn(grown_out, F.when(new < F.col("_best.cost"), len(weights)).otherwise(F.col(out))).drop("_best")


def _bin(order: Sequence[str], bins: int) -> Column:
    digest = F.md5(F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % bins).cast("int")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot", bins: int = 256) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each shard, without bringing a shard's rows together.

    Rows of a shard fall into ``bins`` by a hash of ``order``. The counts of the bins, summed before the shuffle,
    give each bin its first slot; only within a bin are rows numbered one by one. ``order`` should tell rows apart:
    equal rows share a bin, and as they are equal either may come first.
    """
    df = df.withColumn("_slot_bin", _bin(order, bins))
    counts = df.groupBy(shard, "_slot_bin").agg(F.count(F.lit(1)).alias("_slot_n"))
    below = W.partitionBy(shard).orderBy("_slot_bin").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(shard).alias("_slot_shard"), F.col("_slot_bin").alias("_slot_of"), F.coalesce(F.sum("_slot_n").over(below), F.lit(0)).alias("_slot_before"))
    within = df.withColumn("_slot_at", F.row_number().over(W.partitionBy(shard, "_slot_bin").orderBy(*order)) - 1)
    # at most shards x bins rows: a size that doesn't grow with the data
    joined = within.join(F.broadcast(counts), (F.col(shard).eqNullSafe(F.col("_slot_shard"))) & (F.col("_slot_bin") == F.col("_slot_of")), "left")
    return joined.withColumn(out, F.col("_slot_before") + F.col("_slot_at")).drop("_slot_bin", "_slot_n", "_slot_shard", "_slot_of", "_slot_before", "_slot_at")
