"""Quality by nearest-neighbour voting in a latent semantic space.

TF-IDF vectors of hashed byte trigrams are reduced by a truncated singular value decomposition of a bounded labelled sample.
The sample's vectors are broadcast (SAMPLE rows of RANK numbers); every document is compared with all of them by exact
cosine, in blocks, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm import features, folds
from wayfold.llm import kernels as K

GRAM, DIMENSION_BITS, RANK = 3, 13, 48
#: Classes of how often a text's trigrams come, and their weight against the trigrams themselves.
REPEATS, REPEAT_WEIGHT = 12, 2.0
#: Labelled documents that are learned from, neighbours that vote, and the power of the cosine that weights a vote.
SAMPLE, NEIGHBOURS, POWER = 4000, 25, 8.0


class Model(NamedTuple):
    basis: np.ndarray  #: feature weights times right singular vectors
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _weighted(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight): trigrams by the logarithm of their count, and how much of the text lies in trigrams that come once, twice, 4, 8, ... times."""
    row, feature, count = features.ngram_counts(c, GRAM, DIMENSION_BITS)
    bucket = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), REPEATS - 1)
    share = np.bincount(row * REPEATS + bucket, count, minlength=c.rows * REPEATS).reshape(c.rows, REPEATS)
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    r, b = np.nonzero(share)
    norm = np.sqrt(np.bincount(row, (1 + np.log(count)) ** 2, minlength=c.rows))
    row, feature = np.concatenate([row, r]), np.concatenate([feature, (1 << DIMENSION_BITS) + b])
    value = np.concatenate([1 + np.log(count), REPEAT_WEIGHT * norm[r] * share[r, b]])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order].astype(np.float32)


def _latent(c: K.Chunk, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of a chunk's rows; zero for texts without a trigram."""
    row, feature, value = _weighted(c)
    return features.unit(features.project(row, value, feature, basis, c.rows))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc: str = "doc_id", text: str = "text", most: int = SAMPLE, rank: int = RANK) -> Model:
    """Learns from the documents that ``labels`` (doc_id, label 0 or 1) names; feature frequencies count all of ``docs``, whose labels they don't see."""
    df, n = features.document_frequencies(docs, GRAM, DIMENSION_BITS, text=text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    some = folds.labelled_sample(docs, labels, label, most, doc=doc, text=text).toArrow()
    idf = np.concatenate([idf, np.full(REPEATS, np.mean(idf), np.float32)])
    size = len(idf)
    rows = []
    for c in K.chunks(some.column(0)):
        row, feature, value = _weighted(c)
        x = np.zeros((c.rows, size), np.float32)
        x[row, feature] = value * idf[feature]
        rows.append(features.unit(x).astype(np.float16))
    if not rows:
        return Model(np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    # the right singular vectors, from a randomised range of the sample's rows
    rng = np.random.default_rng(7)
    rank = min(rank, len(some))
    basis = rng.standard_normal((size, rank + 8)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(sum(x.astype(np.float32).T @ (x.astype(np.float32) @ basis) for x in rows))[0]
    small = sum((y := x.astype(np.float32) @ basis).T @ y for x in rows)
    values, vectors = np.linalg.eigh(small)
    basis = (basis @ vectors[:, ::-1][:, :rank]).astype(np.float32)
    latent = features.unit(np.vstack([x.astype(np.float32) @ basis for x in rows])).astype(np.float32)
    y = some.column(1).to_numpy().astype(float)
    return Model(basis * idf[:, None], latent, y, float(y.mean()))


def score(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the weighted share of label 1 among its nearest labelled texts, 0 to 1.

    Texts without a trigram (null, empty, very short) get the labelled sample's share of label 1; so do all without a sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = min(neighbours, len(m.labels))
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                out = np.full(c.rows, m.prior)
                if k:
                    x = _latent(c, m.basis)
                    for lo in range(0, c.rows, 256):
                        cosine = x[lo : lo + 256] @ m.vectors.T
                        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(float) ** POWER
                        out[lo : lo + 256] = (weight * m.labels[near]).sum(axis=1) / weight.sum(axis=1)
                    out[~x.any(axis=1)] = m.prior
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(np.clip(out, 0, 1))], ["doc", "score"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(run, f"doc {kind}, score double").withColumnRenamed("doc", doc)
