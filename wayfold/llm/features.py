"""Hashed byte n-grams as sparse rows: what the classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import kernels as K


def ngram_counts(c: K.Chunk, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the hashed n-byte strings within each row of a chunk, sorted by row and feature."""
    data = c.data
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        code = code << np.uint64(8) | data[i : len(data) - n + 1 + i].astype(np.uint64)
    feature = ((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    sizes = np.maximum(np.diff(c.offsets) - n + 1, 0)
    row = np.repeat(np.arange(c.rows), sizes)
    at = np.arange(len(row)) - np.repeat(K.starts(sizes)[:-1] - c.offsets[:-1], sizes)
    return _collapse(row, feature[at], c.rows, bits)


def _collapse(row: np.ndarray, feature: np.ndarray, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if rows << bits <= 1 << 24:
        counts = np.bincount(row << bits | feature, minlength=rows << bits)
        at = np.flatnonzero(counts)
        return at >> bits, at & ((1 << bits) - 1), counts[at]
    at, counts = np.unique(row << bits | feature, return_counts=True)
    return at >> bits, at & ((1 << bits) - 1), counts


def project(row: np.ndarray, value: np.ndarray, feature: np.ndarray, table: np.ndarray, rows: int) -> np.ndarray:
    """Sums of value * table[feature] by row: a sparse matrix (rows in order) times a dense one, in slices of bounded size."""
    out = np.zeros((rows, table.shape[1]), np.float32)
    step = max(1, (1 << 22) // table.shape[1])
    for lo in range(0, len(row), step):
        r, part = row[lo : lo + step], table[feature[lo : lo + step]] * value[lo : lo + step, None]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(part, first, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, gram: int, bits: int, prepare: Callable[[K.Chunk], K.Chunk] | None = None, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all ``docs`` have each of the 2**bits features, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for c in K.chunks(batch.column(0)):
                total += np.bincount(ngram_counts(prepare(c) if prepare else c, gram, bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["feature", "n"])

    got = docs.select(text).mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())
