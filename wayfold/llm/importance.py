"""Importance resampling towards a target distribution over hashed word n-grams.

An integer word dictionary does the hashing: the distinct words of a chunk of texts get ids, an n-gram is the tuple of its words' ids
(itself numbered: the number of the n-gram without its last word, and that word's id), and the bytes that a distinct tuple stands for are hashed once. What the
tuples' hashes say is then joined back to every place where a tuple stands, by its number. A dictionary lives as long as its chunk: a corpus-wide
one would have to shuffle every word of the corpus to save hashes that cost less than the shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import kernels as K
from wayfold.llm.storage import materialize

#: Buckets of hashed n-grams, the longest n-gram, and the least number of words of a document that may be drawn.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 2, 20
#: Bytes of text that share a dictionary; a longer text has its own.
CHUNK = 1 << 22
#: Documents of one score are numbered in this many runs by id, so that no score's documents meet in one task.
RUNS = 64
#: Bytes between words of lower-cased text: all of ASCII but digits and letters.
BETWEEN = np.array([b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


class Features(NamedTuple):
    row: np.ndarray  #: the row of the chunk that each feature stands in
    bucket: np.ndarray  #: its bucket
    n_words: np.ndarray  #: words of each row


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every value's number in order of first occurrence, and the distinct values: an exact dictionary."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def features(c: K.Chunk, buckets: int = BUCKETS, longest: int = LONGEST) -> Features:
    """All runs of 1 to ``longest`` words of each row, repeats included; they never cross rows."""
    lower = K.Chunk(c.first, K.LOWER[c.data], c.offsets)
    w = K.words(lower, BETWEEN)
    if not len(w.start):
        return Features(np.zeros(0, np.int64), np.zeros(0, np.int64), w.per_doc)
    bytes_of = np.ascontiguousarray(lower.data[~BETWEEN[lower.data]])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(K.starts(w.end - w.start)), pa.py_buffer(bytes_of)])
    ids, dictionary = _numbered(found)
    distinct = dictionary.to_pylist()
    following = [b" " + word for word in distinct]
    hashes = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    number, at = ids, np.arange(len(ids))  # each n-gram's number among the distinct tuples, and its first word
    rows, found_in = [w.doc], [(hashes % buckets)[number]]
    for n in range(2, longest + 1):
        on = at[: np.searchsorted(at, len(ids) - n + 1)]
        stays = w.doc[on] == w.doc[on + n - 1]
        at, before = on[stays], number[: len(on)][stays]
        if not len(at):
            break
        number, tuples = _numbered(pa.array(before * len(distinct) + ids[at + n - 1]))
        head, last = np.divmod(tuples.to_numpy(), len(distinct))
        # a checksum goes on from that of the tuple without its last word: the result is that of all its bytes
        hashes = np.fromiter(map(zlib.crc32, map(following.__getitem__, last.tolist()), hashes[head].tolist()), np.int64, len(head))
        rows.append(w.doc[at])
        found_in.append((hashes % buckets)[number])
    return Features(np.concatenate(rows), np.concatenate(found_in), w.per_doc)


def bucket_counts(texts: DataFrame, text: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket: a task sends at most ``buckets`` sums, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for c in K.chunks(batch.column(0), CHUNK):
                total += np.bincount(features(c, buckets, longest).bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    counted = texts.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "bucket int, n bigint")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, with one more feature in every bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, *, doc: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc, n_words, n_features, weight) for each row: weight is the mean of the gains of its features, rounded down, and 0 without any."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c in K.chunks(batch.column(1), CHUNK):
                f = features(c, len(gain), longest)
                n = np.bincount(f.row, minlength=c.rows)
                total = np.bincount(f.row, gain[f.bucket].astype(np.float64), c.rows).astype(np.int64)  # whole numbers, so sums of doubles are exact
                n_words.append(f.n_words)
                n_features.append(n)
                weight.append(total // np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in (n_words, n_features, weight))], ["doc", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, rounded down, that seed and id decide; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, share: int) -> DataFrame:
    """``rows`` with rank: 1, 2, 3, ... for the floor(share * n / 100) highest scores of the n rows that are fit, ties to smaller ids; else null.

    Scores are whole numbers of a few tens of thousands of values: their counts give each score its first rank. Of one score's documents, runs by
    id are counted likewise, and only within a run are documents numbered one by one. Null ids come last.
    """
    fit = F.col("n_words") >= LEAST_WORDS
    span = rows.filter(fit).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    drawn = share * span.n // 100
    part = F.lit(0)
    if isinstance(span.lo, int):
        part = F.floor((F.col("doc").cast("double") - F.lit(float(span.lo))) / F.lit(max(float(span.hi - span.lo), 1.0)) * RUNS)
    rows = rows.withColumn("part", F.coalesce(part.cast("int"), F.lit(RUNS + 1)))
    cells = rows.filter(fit).groupBy("score", "part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are scores: their range, not the input, bounds them
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = cells.groupBy("score").agg(F.sum("n").alias("n")).select("score", above.alias("above")).filter(F.col("above") < drawn)
    within = F.coalesce(F.sum("n").over(W.partitionBy("score").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("score", "part", within.alias("within")).join(first, "score")
    starts = materialize(starts.select("score", "part", (F.col("above") + F.col("within")).alias("before")).filter(F.col("before") < drawn), "starts", keep=True)
    order = W.partitionBy("score", "part").orderBy(F.asc_nulls_last("doc"), "n_features", "n_words")
    rank = F.col("before") + F.row_number().over(order)
    high = rows.filter(fit).join(starts, ["score", "part"]).withColumn("rank", F.when(rank <= drawn, rank)).drop("before")
    rest = rows.join(starts.withColumn("fits", F.lit(True)), ["score", "part"], "left").filter(~fit | F.col("fits").isNull())
    return high.unionByName(rest.withColumn("rank", F.lit(None).cast("long")).drop("before", "fits")).drop("part")


def resample(docs: DataFrame, target: DataFrame, *, doc: str = "doc_id", text: str = "text", target_text: str = "text", share: int = 25, seed: int = 7) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score and, for the ``share`` percent that are drawn, rank (1, 2, 3, ...).

    A document's weight is its features' mean log-ratio of the target's to the documents' distribution; Gumbel noise on it draws without
    replacement in proportion to the ratios. Documents under ``LEAST_WORDS`` words are never drawn. Null texts count as empty: no features,
    weight 0. Rows that repeat an id repeat its noise; each has a rank of its own. Empty tables give an empty result; an empty target counts nothing. Other columns
    are ignored.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weights(docs, gain, doc=doc, text=text).withColumn("score", F.col("weight") + noise(F.col("doc"), seed))
    ranked = _ranked(materialize(scored, "scored", keep=True), share)
    return ranked.select(F.col("doc").alias(doc), "n_features", "weight", "score", "rank")
