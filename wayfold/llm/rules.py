"""Quality rules: text statistics, and perplexity bands under a modified Kneser-Ney model that Spark counts over the whole corpus.

The model's units are classes of bytes (case, digits and punctuation stay apart; non-ASCII bytes share a few classes), in
trigrams. So it has at most 2**21 trigrams however large the corpus, and what it counts grows with every document.
Entries stand in arrays sorted by hash; a task looks up each different trigram once. By default one model serves all
languages, so that a text in two languages isn't taken for noise; the bands are each language's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import kernels as K
from wayfold.llm.storage import materialize, temporary

#: Base rules: fewest words, and the largest share of words in repeated 5-word windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The name of the one model that serves all languages.
OTHER = "*"
#: Bits of a byte class.
BITS = 7
#: A text is rejected if its log-probability by word is off its language's median by more than the band: so many quartile distances, and so
#: many times what chance moves a text of its length by (the language's median of that), as the root of the sum of squares.
BAND, ERRORS = 1.0, 6.5

_CLASS = np.full(256, 1, np.int32)  # control characters
_CLASS[32:127] = np.arange(2, 97)
_CLASS[10] = 97
_CLASS[128:192] = 98 + (np.arange(64) & 15)  # continuation bytes
_CLASS[192:256] = 114 + (np.arange(64) & 7)  # lead bytes
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True


def _trigrams(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte-class trigrams that lie in one row, and the row of each."""
    x = _CLASS[c.data]
    if len(x) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    code = (x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:]
    sizes = np.maximum(np.diff(c.offsets) - 2, 0)
    row = np.repeat(np.arange(c.rows), sizes)
    at = np.arange(len(row)) - np.repeat(K.starts(sizes)[:-1] - c.offsets[:-1], sizes)
    return code[at], row


def count_trigrams(docs: DataFrame, lang: Column, text: str = "text") -> DataFrame:
    """(lang, code, n) over all documents; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for name, total in held.items():
                code = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.astype(np.int32)), pa.array(total[code])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for c in K.chunks(batch.column(1), K.DENSE):
                code, row = _trigrams(c)
                own = names[c.first : c.first + c.rows]
                for name in np.unique(own):
                    held.setdefault(name, np.zeros(1 << 3 * BITS, np.int64))
                    np.add.at(held[name], code[(own == name)[row]], 1)
            if len(held) > 8:
                yield from flush()
        yield from flush()

    return docs.select(lang.alias("lang"), text).mapInArrow(run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame, context: Sequence[str]) -> DataFrame:
    """Adds discounted (what is left of n) and, by context, total and freed (the mass that discounts free), with a language's three discounts."""
    of = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    by_lang = counts.groupBy("lang").agg(*(x.alias(f"n{i + 1}") for i, x in enumerate(of)))
    y = F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5))
    # where too few n-grams are that rare the estimate is undefined or out of range: the usual bounds then
    each = [F.greatest(F.lit(0.1 * i), F.least(F.coalesce(F.lit(float(i)) - (i + 1) * y * F.try_divide(b, a), F.lit(0.5 * i)), F.lit(0.9 * i))) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    by_lang = by_lang.select("lang", *(d.alias(f"d{i + 1}") for i, d in enumerate(each)))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # one row for each language of the model
    out = counts.join(F.broadcast(by_lang), "lang").withColumn("cut", cut)
    by = W.partitionBy("lang", *context)
    return out.withColumn("total", F.sum("n").over(by)).withColumn("freed", F.sum("cut").over(by)).withColumn("discounted", F.col("n") - F.col("cut")).drop("d1", "d2", "d3", "cut")


class Model(NamedTuple):
    """Sorted hash arrays: log-probabilities of seen n-grams and log-weights of contexts, keyed by the hash of language, kind and code."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, kind: int, lang: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of codes, and which of them the model has."""
        key = _key(kind, lang, code)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.values[at], self.keys[at] == key

    def log_probability(self, lang: str, code: np.ndarray) -> np.ndarray:
        """log P(third | first two) of trigram codes; backs off to bigrams, single classes and the uniform distribution."""
        if not len(self.keys):
            return np.full(len(code), -BITS * np.log(2))
        out, seen = self.find(3, lang, code)
        weight, known = self.find(23, lang, code >> BITS)
        lower = self._bigram(lang, code & ((1 << 2 * BITS) - 1))
        return np.where(seen, out, np.where(known, weight, 0.0) + lower)

    def _bigram(self, lang: str, code: np.ndarray) -> np.ndarray:
        out, seen = self.find(2, lang, code)
        weight, known = self.find(12, lang, code >> BITS)
        single, there = self.find(1, lang, code & ((1 << BITS) - 1))
        never, trained = self.find(0, lang, np.zeros(1, np.int64))
        floor = never[0] if trained[0] else -BITS * np.log(2)
        return np.where(seen, out, np.where(known, weight, 0.0) + np.where(there, single, floor))


def _key(kind: int, lang: str, code: np.ndarray) -> np.ndarray:
    seed = int.from_bytes(lang.encode()[-6:], "little") * 64 + kind
    return K.mix(np.asarray(code).astype(np.uint64) + (np.uint64(seed & ((1 << 42) - 1)) << np.uint64(22)))


def train(docs: DataFrame, lang: Column, text: str = "text") -> Model:
    """Interpolated modified Kneser-Ney: trigram counts over all of ``docs``, lower orders from continuation counts.

    What comes to the driver is the finished model, bounded by the number of byte-class trigrams a language.
    """
    with temporary(docs.sparkSession):
        return _estimated(materialize(count_trigrams(docs, lang, text), "trigrams"))


def _estimated(counts: DataFrame) -> Model:
    """The model of trigram counts (lang, code, n).

    Each order's table, of bounded size, is written before the next reads it: in one plan every order would stand in it several
    times over, and what the driver needs to plan and to describe that outweighs the model.
    """
    three = counts.withColumn("context", F.shiftright("code", BITS)).withColumn("low", F.col("code").bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
    two = materialize(three.groupBy("lang", F.col("low").alias("code")).agg(F.count(F.lit(1)).alias("n")), "bigrams")
    two = two.withColumn("context", F.shiftright("code", BITS)).withColumn("low", F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)))
    one = two.groupBy("lang", F.col("low").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # single classes: continuation counts with one added to each class, so that none has probability 0
    mass = F.sum("n").over(W.partitionBy("lang")) + (1 << BITS)
    one = materialize(one.withColumn("p1", (F.col("n") + 1) / mass).withColumn("p0", 1 / mass).withColumn("zero", F.lit(0)), "classes")
    weight = (F.col("freed") / F.col("total")).alias("weight")
    columns = lambda p, lower: ("lang", "code", "context", weight, (F.col("discounted") / F.col("total") + F.col("freed") / F.col("total") * F.col(lower)).alias(p))
    two = _discounted(two, ["context"]).join(one.select("lang", F.col("code").alias("low"), "p1"), ["lang", "low"])
    two = materialize(two.select(*columns("p2", "p1")), "bigram_values")
    three = _discounted(three, ["context"]).join(two.select("lang", F.col("code").alias("low"), "p2"), ["lang", "low"])
    three = materialize(three.select(*columns("p3", "p2")), "trigram_values")
    rows = lambda kind, df, code, p: df.select(F.lit(kind).alias("kind"), "lang", F.col(code).cast("int").alias("code"), F.ln(p).cast("float").alias("value"))
    entries = rows(3, three, "code", F.col("p3")).union(rows(2, two, "code", F.col("p2"))).union(rows(1, one, "code", F.col("p1")))
    entries = entries.union(rows(0, one, "zero", F.col("p0")).distinct()).union(rows(23, three, "context", F.col("weight")).distinct()).union(rows(12, two, "context", F.col("weight")).distinct())
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    got = entries.toArrow().to_pandas()
    for (kind, name), part in got.groupby(["kind", "lang"]):
        keys.append(_key(int(kind), name, part["code"].to_numpy()))
        values.append(part["value"].to_numpy(np.float32))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    return Model(keys[order], values[order])


def _repeat_words(c: K.Chunk, w: K.Words) -> np.ndarray:
    """Words of each row that lie in 5-word windows found twice or more in it."""
    h, at = K.window_hashes(K.word_hashes(c, w, lower=False), w.doc, 5)
    order = np.lexsort((h, w.doc[at]))
    h, at = h[order], at[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (w.doc[at[1:]] == w.doc[at[:-1]])
    twice = at[same[1:] | same[:-1]]
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    return np.bincount(w.doc[np.cumsum(edge)[:-1] > 0], minlength=c.rows)


def _duplicate_lines(c: K.Chunk) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line."""
    n = len(c.data)
    if not n:
        return np.zeros(c.rows, np.int64)
    breaks = np.flatnonzero(c.data == 10)
    start = np.concatenate([c.offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(c.rows), np.searchsorted(c.offsets, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, n)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = c.offsets[row[last] + 1]
    filled = np.concatenate([[0], np.cumsum(~K.SPACE[c.data])])
    keep = filled[end] > filled[start]
    h, row = K.range_hash(K.prefix_hash(c.data), start[keep], end[keep]), row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    return np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=c.rows)


def measure(docs: DataFrame, model: Model | None, lang: Column, *, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``carry`` columns of each row and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, model_lang, n_grams, log_probability (of the text, by word; null without words, trigrams or model)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names_of = ["_text" if x == text else x for x in carry]  # a text that is carried goes to the workers once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist())
            for c in K.chunks(batch.column(0), K.DENSE):
                w = K.words(c)
                per = lambda flag, c=c: np.diff(np.concatenate([[0], np.cumsum(flag)])[c.offsets])
                points = ~K.SPACE[c.data] & ((c.data & 0xC0) != 0x80)
                code, row = _trigrams(c)
                n, total = np.bincount(row, minlength=c.rows), np.zeros(c.rows)
                own = names[c.first : c.first + c.rows]
                for name in np.unique(own) if shared.value else ():
                    mine = (own == name)[row]
                    value, known = tables.setdefault(name, (np.zeros(1 << 3 * BITS, np.float32), np.zeros(1 << 3 * BITS, bool)))
                    codes = code[mine]
                    new = np.unique(codes[~known[codes]])
                    value[new], known[new] = shared.value.log_probability(name, new), True
                    total += np.bincount(row[mine], value[codes], minlength=c.rows)
                if len(tables) > 8:
                    tables.clear()
                mean = pa.array(total / np.maximum(w.per_doc, 1), mask=(n == 0) | (w.per_doc == 0) | (shared.value is None))
                stats = [w.per_doc, per(points), per(_SYMBOL[c.data]), _duplicate_lines(c), _repeat_words(c, w)]
                rest = [batch.column(name).slice(c.first, c.rows) for name in names_of]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x.astype(np.int64)) for x in stats), batch.column(1).slice(c.first, c.rows), pa.array(n.astype(np.int64)), mean], [*carry, *_MEASURES])

    kinds = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in carry)
    schema = (kinds + ", " if kinds else "") + "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, model_lang string, n_grams bigint, log_probability double"
    return docs.select(F.col(text).alias("_text"), lang.alias("_lang"), *(x for x in carry if x != text)).mapInArrow(run, schema)


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "model_lang", "n_grams", "log_probability"]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """(band_lang, middle, spread, noise): for each value of lang, null included, from all documents that pass the base rules, the median of
    log_probability, its quartile distance, and the median distance from the middle times the root of the text's words."""
    passed = measured.filter(~base_failed() & F.col("log_probability").isNotNull()).select("band_lang", "log_probability", "n_words")
    quart = F.percentile_approx("log_probability", [0.25, 0.5, 0.75], 10000)
    middle = passed.groupBy("band_lang").agg(quart.alias("q")).select("band_lang", F.col("q")[1].alias("middle"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))
    off = F.abs(F.col("log_probability") - F.col("middle")) * F.sqrt("n_words")
    noise = _with_language(passed, middle).groupBy("band_lang").agg(F.percentile_approx(off, 0.5, 10000).alias("noise"))
    return _with_language(middle, noise)


def _with_language(rows: DataFrame, languages: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their band_lang's row; null is a language of its own."""
    of = languages.withColumnRenamed("band_lang", "_band_of")
    # one row for each value of lang
    return rows.join(F.broadcast(of), F.col("band_lang").eqNullSafe(F.col("_band_of")), how).drop("_band_of")


def verdict(measured: DataFrame, band: DataFrame) -> DataFrame:
    """Adds base_failed and kept: kept if the base rules pass and the log-probability by word is within the language's band, lower and upper."""
    joined = _with_language(measured, band, "left")
    room = F.sqrt(F.pow(F.lit(BAND) * F.col("spread"), 2) + F.pow(F.lit(ERRORS) * F.col("noise"), 2) / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.abs(F.col("log_probability") - F.col("middle")) <= room, F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, *, lang: str = "lang", text: str = "text", carry: Sequence[str] = ("doc_id",), reuse: bool = True) -> DataFrame:
    """``carry`` columns, the statistics, base_failed and kept for each row of ``docs``; the model and the bands come from all of ``docs``.

    ``reuse`` writes the measured rows once, with what they carry, instead of measuring again for the bands.
    A null text has no words and fails. An empty table gives an empty one.
    """
    model = train(docs, F.lit(OTHER), text)
    measured = measure(docs, model, F.lit(OTHER), text=text, carry=[*carry, lang] if lang not in carry else carry)
    measured = measured.withColumn("band_lang", F.col(lang))
    if reuse:
        measured = materialize(measured, "measured")
    out = verdict(measured, materialize(bands(measured), "bands"))
    return out if lang in carry else out.drop(lang)


def keep_good(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their own columns."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*own)  # so that no column clashes with a statistic's name
    name = dict(zip(docs.columns, own))
    kept = judge(renamed, lang=name[lang], text=name[text], carry=own).filter("kept")
    return kept.select(*own).toDF(*docs.columns)
