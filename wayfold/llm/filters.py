"""Bitmaps of hashed keys: a sieve before a shuffle, sized by the number of keys. They let some rows through too many, never too few."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, so that about one row in sixteen that isn't wanted gets through; a bitmap has between 2**LEAST and 2**MOST bits.
EACH, LEAST, MOST = 16, 16, 28


def bits_for(n: int) -> int:
    """The logarithm of a bitmap's size for n keys, without an upper bound: callers compare it with MOST."""
    return max(LEAST, (max(n, 1) * EACH - 1).bit_length())


def bit_of(key: Column, bits: int) -> Column:
    """Which of 2**bits bits a 64-bit hash sets."""
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(rows: DataFrame, key: Column, bits: int) -> np.ndarray:
    """The bits that ``key`` sets over all rows: at most 2**(bits - 6) numbers come to the driver, whatever the input's size."""
    bit = bit_of(key, bits)
    words = rows.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at")).filter("word is not null")
    got = words.select("word", F.expr("shiftleft(1L, at)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def holds(known: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which of the bits are set."""
    bit = bit.astype(np.int64)
    return (known[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def among(rows: DataFrame, wanted: DataFrame, key: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: str | None = None) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``wanted``, and, where a bitmap sieves them, a few more.

    Up to 2**MOST / EACH different keys a broadcast bitmap keeps other rows from being shuffled at all; beyond that it would be too
    large, and a semi-join picks the rows. What comes of the batches is given to ``then``, whose rows have ``schema``: in the workers that
    sieve, since a mapInArrow after this one would take a second worker for each task, and workers keep their memory.
    """
    wanted = wanted.toDF("_wanted")
    bits = bits_for(wanted.count())
    if bits > MOST:
        picked = rows.join(wanted, rows[key] == F.col("_wanted"), "left_semi")
        return picked.mapInArrow(then, schema) if schema else picked
    known = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, F.xxhash64("_wanted"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(holds(known.value, batch.column(batch.num_columns - 1).to_numpy()))
            if len(hit):
                yield batch.take(pa.array(hit)).select(range(batch.num_columns - 1))

    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_bit", bit_of(F.xxhash64(key), bits))
    return keyed.mapInArrow(lambda batches: then(run(batches)), schema or rows.schema)
