"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % n


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))


def likely_share(most: int, n: int) -> float:
    """The share of n rows, by hash, that holds the ``most`` least with near certainty and not many more."""
    return min(1.0, (most + 8 * most**0.5 + 20) / max(n, 1))


def sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``key``: the same at every run and partitioning.

    Rows that can't be among them are left out where they are read, so that few more than ``most`` meet in one task.
    """
    few = rows.withColumn("_order", unit_hash(key)).filter(F.col("_order") < likely_share(most, rows.count()))
    return few.orderBy("_order", key).limit(most).drop("_order")


def within_bytes(rows: DataFrame, text: str, order: Sequence[str], most_bytes: int) -> DataFrame:
    """Of a bounded number of rows, in order, those that together hold at most ``most_bytes``; whole texts, and always the first.

    Only ids and sizes stand in the window's one task: ``order`` must tell rows apart.
    """
    before = F.sum("_size").over(W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.select(*order, F.octet_length(text).alias("_size")).withColumn("_fits", F.coalesce(before, F.lit(0)) + F.col("_size") <= most_bytes)
    first = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) == 1
    return rows.join(F.broadcast(sizes.withColumn("_fits", F.col("_fits") | first).filter("_fits").select(*order)), list(order), "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, doc: str = "doc_id", text: str = "text", most_bytes: int = 1 << 27) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents with a text, those with the least hash of their id, in that order.

    The ids are drawn from ``labels`` first, so the side that is broadcast has at most ``most`` rows; ids without a document and
    null labels are left out. Of several labels of one id the smallest counts, of several texts the one with the smallest hash.
    Texts beyond ``most_bytes`` bytes together are left out, so that the sample fits the driver whatever the texts' lengths.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg(F.min(label).alias(label))
    drawn = sample(one, F.col(doc), most)
    texts = docs.filter(F.col(text).isNotNull()).select(doc, text).join(F.broadcast(drawn), doc)
    texts = texts.groupBy(doc, label).agg(F.min_by(text, F.struct(F.xxhash64(text), F.col(text))).alias(text)).withColumn("_order", unit_hash(F.col(doc)))
    return within_bytes(texts, text, ["_order", doc], most_bytes).orderBy("_order", doc).select(text, label)
