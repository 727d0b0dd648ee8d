"""Language identification by nearest centroids.

A text is a vector of hashed byte trigrams, weighted by TF-IDF and scaled to length one. Each language has several centroids,
found by spherical k-means among a bounded sample of its texts; document frequencies come from all texts that may be
learned from. A text gets the language of the centroid with the largest cosine, and is rejected if that centroid is
farther than nearly all of the texts it was made from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import features, folds
from wayfold.llm import kernels as K

GRAM, DIMENSION_BITS = 3, 13
#: Sampled texts and centroids of each language.
SAMPLE, CENTROIDS = 600, 4
#: Languages that are learned: the model holds centroids for each, so its size needs a bound. Of more, those with the most texts.
MOST_LANGUAGES = 1024
#: Texts of the sample beyond so many bytes for each language aren't brought to the driver.
SAMPLE_BYTES = 1 << 25
#: A text farther from its centroid than this share of the sampled texts, times SLACK, is rejected.
REJECT_QUANTILE, SLACK = 0.995, 1.25

#: Bytes that may be letters: ASCII letters, and what isn't ASCII (a second look decides).
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letters(c: K.Chunk) -> K.Chunk:
    """A chunk's letters in lower case (ASCII and Latin-1); each run of anything else becomes one space, at a row's beginning none."""
    data = K.LOWER[c.data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][latin] += 0x20
    plain = (data < 128) & ~_ASCII_LETTER[data]
    data[plain] = 32
    keep = ~plain
    keep[1:] |= ~plain[:-1]
    first = c.offsets[:-1][c.offsets[:-1] < len(data)]
    keep[first] = ~plain[first]  # what the row before ends in doesn't matter
    kept = np.concatenate([[0], np.cumsum(keep)])
    return K.Chunk(c.first, data[keep], kept[c.offsets])


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  #: the language of each centroid
    radius: np.ndarray  #: least cosine that a centroid accepts


def vectors(c: K.Chunk, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of a chunk; the frequency of a trigram counts by its logarithm."""
    row, feature, count = features.ngram_counts(letters(c), GRAM, DIMENSION_BITS)
    out = np.zeros((c.rows, len(idf)), np.float32)
    out[row, feature] = (1 + np.log(count)) * idf[feature]
    return features.unit(out)


def _cosines(c: K.Chunk, model: Model) -> np.ndarray:
    row, feature, count = features.ngram_counts(letters(c), GRAM, DIMENSION_BITS)
    value = ((1 + np.log(count)) * model.idf[feature]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, minlength=c.rows))
    return features.project(row, value, feature, model.centroids.T, c.rows) / np.maximum(norm, 1e-12)[:, None]


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from texts far apart."""
    centers = x[:1]
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[np.argmin(np.max(x @ centers.T, axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(x @ centers.T, axis=1)
        centers = features.unit(np.vstack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(len(centers))]))
    return centers


def train(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from ``docs``, all of which may be learned from; rows without text or lang are left out.

    Document frequencies count all rows; centroids are made from at most ``per_language`` texts of each language, those
    with the least hash of id and text. More than MOST_LANGUAGES languages aren't told apart: the rarest are not learned.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = features.document_frequencies(rows, GRAM, DIMENSION_BITS, letters, text)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES).collect()}
    names = sorted(counts)
    drawn = rows.select(F.col(lang).alias("lang"), folds.unit_hash(F.col(doc), F.col(text)).alias("order"), F.col(text).alias("text"))
    if names:
        share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, folds.likely_share(per_language, n))))
        drawn = drawn.filter(F.col("order") < F.try_element_at(share, F.col("lang")))
    # a few more than per_language rows a language are left; which of them stay doesn't depend on partitions
    by = W.partitionBy("lang").orderBy("order", F.xxhash64("text"))
    held = F.sum(F.octet_length("text")).over(by.rowsBetween(W.unboundedPreceding, 0))
    nth = F.row_number().over(by)
    drawn = drawn.withColumn("nth", nth).withColumn("held", held).filter((F.col("nth") <= per_language) & ((F.col("held") <= SAMPLE_BYTES) | (F.col("nth") == 1)))
    drawn = drawn.select("lang", "order", "text").toArrow().sort_by("order")
    centers, owner, radius = [np.zeros((0, len(idf)), np.float32)], [], []
    for i, name in enumerate(names):
        some = drawn.filter(pc.equal(drawn.column("lang"), name)).slice(0, per_language)
        x = np.vstack([vectors(c, idf) for c in K.chunks(some.column("text"))])
        own = _k_means(x, centroids)
        cosine = x @ own.T
        nearest = np.argmax(cosine, axis=1)
        for j in range(len(own)):
            near = cosine[nearest == j, j] if (nearest == j).any() else cosine.max(axis=1)
            radius.append(1 - (1 - np.quantile(near, 1 - REJECT_QUANTILE)) * SLACK)
        centers.append(own)
        owner += [i] * len(own)
    return Model(names, idf, np.vstack(centers).astype(np.float32), np.array(owner, np.int64), np.array(radius))


def _has_letter(text: str) -> bool:
    return any(x.isalpha() for x in text)


def predict(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) for each row of ``docs``.

    lang_pred is ``und`` if the text is null or has no letter, else the language of the nearest centroid, also where the
    text is rejected as too far from it. score is that language's share: the largest cosine among its centroids against
    the best of another language, mapped to 0 to 1; 0 for ``und``. Without any learned language all texts are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                ids, texts = batch.column(0).slice(c.first, c.rows), batch.column(1).slice(c.first, c.rows)
                ascii_letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[c.data])])[c.offsets]) > 0
                known = ascii_letters.copy()
                for i in np.flatnonzero(~ascii_letters):
                    known[i] = _has_letter(texts[i].as_py() or "")
                if not m.languages:
                    known[:] = False
                    best = second = np.zeros(c.rows)
                    pick = radius = best
                else:
                    cosine = _cosines(c, m)
                    by = np.stack([cosine[:, m.owner == i].max(axis=1) for i in range(len(m.languages))], axis=1)
                    pick = np.argmax(by, axis=1)
                    best = by.max(axis=1)
                    by[np.arange(c.rows), pick] = -1
                    second = np.maximum(by.max(axis=1), 0)
                    radius = m.radius[np.argmax(cosine, axis=1)]
                names = np.array([*m.languages, "und"], object)
                score = np.where(known, np.clip(0.5 + 0.5 * (best - second) / np.maximum(best, 1e-9), 0, 1), 0.0)
                frame = {"doc": ids, "lang_pred": pa.array(names[np.where(known, pick, len(m.languages)).astype(int)], pa.string()), "score": pa.array(score), "cosine": pa.array(np.where(known, best, 0.0).astype(float)), "rejected": pa.array(~known | (best < radius))}
                yield pa.RecordBatch.from_arrays(list(frame.values()), list(frame))

    kind = docs.schema[doc].dataType.simpleString()
    out = docs.select(doc, text).mapInArrow(run, f"doc {kind}, lang_pred string, score double, cosine double, rejected boolean")
    return out.withColumnRenamed("doc", doc)

