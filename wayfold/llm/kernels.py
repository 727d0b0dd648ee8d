"""Vectorised text kernels over Arrow string columns.

Spark deals the rows out; inside a task these helpers view a batch's UTF-8 bytes as one numpy array with row
offsets, so that words, shingles and byte windows are hashed without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII upper to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

#: Bytes of a chunk where a kernel holds a dozen 64-bit numbers for each byte: 30 MB of a worker's memory, which it keeps when its task ends, and not 100.
DENSE = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk(NamedTuple):
    first: int  #: row of the batch that the chunk starts with
    data: np.ndarray  #: the bytes of the chunk's rows, one after another
    offsets: np.ndarray  #: where each row starts; one more than rows

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Runs of whole rows with about ``limit`` bytes; a longer row is a run of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte hashes times powers; range_hash() reads any range from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  #: row within the chunk
    per_doc: np.ndarray  #: words of each row


def words(c: Chunk, between: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that aren't ``between`` (a flag for each byte value; white space if not given), in order."""
    n = len(c.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(c.rows, np.int64))
    inside = ~between[c.data]
    first = np.zeros(n + 1, bool)
    first[c.offsets] = True  # a row's first byte starts a word even where the row before ends in one
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(c.offsets, start, "right") - 1
    return Words(start, end, doc, np.bincount(doc, minlength=c.rows))


def word_hashes(c: Chunk, w: Words, lower: bool = True) -> np.ndarray:
    return range_hash(prefix_hash(LOWER[c.data] if lower else c.data), w.start, w.end)


def window_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and the word that each starts with; windows stay within a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each row's run begins, given the runs' lengths; one more than rows."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
