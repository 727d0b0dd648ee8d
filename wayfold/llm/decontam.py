"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a run of tokens; only positions marked 1 enter its hash, so a substituted
token under a 0 doesn't hide a shared passage. The two masks below are lossless for WINDOW and FEWEST: any WINDOW aligned
tokens of which FEWEST agree hold a hit of one of them (a test tries all substitutions), and so do 13 to 15 tokens with that
share. Items of at most SHORT tokens have masks of their own length. Hits are joined by hash and every alignment they
name is then verified token by token.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import kernels as K
from wayfold.llm.filters import bitmap, bits_for, holds
from wayfold.llm.identity import text_key
from wayfold.llm.storage import materialize, temporary

MASKS = ("11101011", "11001000111")
#: An overlap: so many aligned tokens, of which so many agree. A shorter item must lie in the text whole, with the same share.
WINDOW, FEWEST = 16, 13
#: Items of so many tokens at most have masks of their own.
SHORT = 12
#: The filter before the join has 2**FILTER_BITS bits at most, and a thousand for each seed up to that, as every text has very many seeds to
#: look up. A benchmark so large that it fills up lets more hits into the join.
FILTER_BITS = 26
_REACH = WINDOW + max(map(len, MASKS))

#: Bytes of a token: ASCII letters and digits, and all of non-ASCII characters.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8; every other byte that isn't part of a token becomes a space."""
    out = K.LOWER[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 0x20
    out[~_TOKEN[data]] = 32
    wide = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    for i in range(3):
        out[wide + i] = 32  # the ideographic space
    return out


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of characters of scripts written without spaces, and which of these are lead bytes: CJK, kana, fullwidth forms, Thai, Lao, Tibetan, Myanmar, Khmer."""
    lead, part = np.zeros(len(data), bool), np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xE0)
    at = at[at < len(data) - 2]
    a, b, c = data[at], data[at + 1], data[at + 2]
    three = ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | ((b >= 0xBC) & (b <= 0xBE))))
    three |= ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & ((b <= 0x81) | ((b == 0x82) & (c < 0xA0)) | (b == 0x9E) | (b == 0x9F)))
    four = (a == 0xF0) & (b >= 0xA0)
    lead[at[three | four]] = True
    for i in range(3):
        part[at[three | four] + i] = True
    part[at[four] + 3] = True
    return part, lead


def _split(c: K.Chunk) -> K.Words:
    """Words of a folded chunk; each character of a script without spaces is one of its own."""
    w = K.words(c)
    part, lead = _unspaced(c.data)
    if not lead.any():
        return w
    begins, ends = np.zeros(len(c.data), bool), np.zeros(len(c.data), bool)
    begins[w.start], ends[w.end - 1] = True, True
    inside = ~K.SPACE[c.data]
    begins |= lead
    begins[1:] |= inside[1:] & ~part[1:] & part[:-1]
    ends[:-1] |= inside[:-1] & begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(c.offsets, start, "right") - 1
    return K.Words(start, end, doc, np.bincount(doc, minlength=c.rows))


def _tokens(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk, the row of each, and where each row's tokens begin."""
    folded = K.Chunk(c.first, fold(c.data), c.offsets)
    w = _split(folded)
    return K.word_hashes(folded, w, lower=False), w.doc, K.starts(w.per_doc)


def _seeds(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, token position in the chunk) of every seed; a row shorter than a mask has none of that mask."""
    out_h, out_at = [], []
    for which, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        value = np.full(n, which + 1, np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                value = value * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
        at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
        out_h.append(K.mix(value[at]))
        out_at.append(at)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_at)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Positions of each mask for items of n tokens: of s + 2 blocks each mask skips s, where s substitutions are allowed, so one mask misses them all."""
    allowed = n - -(-n * FEWEST // WINDOW)
    if not allowed:
        return [tuple(range(n))]
    blocks = np.array_split(np.arange(n), allowed + 2)
    return [tuple(int(i) for j, block in enumerate(blocks) if j not in gone for i in block) for gone in itertools.combinations(range(allowed + 2), allowed)]


def _short_seeds(h: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each mask of items of n tokens, the hash at each of ``at``."""
    for which, mask in enumerate(short_masks(n)):
        value = np.full(len(at), n * 64 + which, np.uint64)
        for i in mask:
            value = value * np.uint64(0x9FB21C651E98DF25) + h[at + i]
        yield K.mix(value)


def _short(hashes: np.ndarray) -> np.ndarray:
    """Token hashes cut to 32 bits, for comparing aligned tokens."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def index_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key, tokens, seeds): token hashes of each item and (hash, position) of its seeds. key tells rows apart, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                h, doc, begins = _tokens(c)
                value, at = _seeds(h, doc)
                size = np.diff(begins)
                long = size[doc[at]] > SHORT
                value, at = [value[long]], [at[long]]
                for n in range(1, SHORT + 1):
                    first = begins[:-1][size == n]
                    own = list(_short_seeds(h, first, n)) if len(first) else []
                    value, at = value + own, at + [first] * len(own)
                value, at = np.concatenate(value), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                value, at = value[order], at[order]
                bounds = K.starts(np.bincount(doc[at], minlength=c.rows))
                pairs = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array((at - begins[doc[at]]).astype(np.int32))], ["hash", "at"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), batch.column(1).slice(c.first, c.rows), K.list_array(_short(h), begins, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], ["item", "key", "tokens", "seeds"])

    kind = benchmark.schema[item].dataType.simpleString()
    keyed = benchmark.select(F.col(item), F.xxhash64(item, text).alias("key"), F.col(text))
    return keyed.mapInArrow(run, f"item {kind}, key bigint, tokens array<int>, seeds array<struct<hash:bigint,at:int>>").dropDuplicates(["key"])


def seed_filter(items: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds' hashes, and its bits: sized by the seeds' number, at most 2**(FILTER_BITS - 6) rows come to the driver."""
    seeds = items.select(F.explode("seeds.hash").alias("hash"))
    bits = min(FILTER_BITS, bits_for(64 * seeds.count()))
    return bitmap(seeds, F.col("hash"), bits), bits


def scan(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Regions of texts around seeds that may be the benchmark's: (doc, uid, start, tokens, hits); most texts give none.

    Neighbouring hits share a region, which reaches far enough on both sides for any overlap they may belong to.
    """
    bitmap_of, bits = seed_filter(items)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, low = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                h, row, begins = _tokens(c)
                value, at = _seeds(h, row)
                hit = np.flatnonzero(holds(known, value & low))
                if not len(hit):
                    continue
                order = hit[np.argsort(at[hit], kind="stable")]
                value, at = value[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] - at[:-1] > 2 * _REACH)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                owner = row[at[first]]
                lo = np.maximum(at[first] - _REACH, begins[owner])
                hi = np.minimum(at[last] + _REACH, begins[owner + 1])
                size = hi - lo
                flat = np.arange(size.sum()) - np.repeat(K.starts(size)[:-1] - lo, size)
                region = np.cumsum(new) - 1
                pairs = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array((at - begins[row[at]]).astype(np.int32))], ["hash", "at"])
                rows = pa.array(owner + c.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((lo - begins[owner]).astype(np.int32)), K.list_array(_short(h[flat]), K.starts(size), pa.int32()), pa.ListArray.from_arrays(pa.array(K.starts(np.bincount(region)), pa.int32()), pairs)],
                    ["doc", "uid", "start", "tokens", "hits"],
                )

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc), text_key(doc, text).alias("uid"), F.col(text)).mapInArrow(run, f"doc {kind}, uid binary, start int, tokens array<int>, hits array<struct<hash:bigint,at:int>>")


def short_hits(docs: DataFrame, items: DataFrame, widths: Sequence[int], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Where texts may hold whole items of ``widths`` tokens: (doc, uid, hash, tokens, starts), one row for each seed and run of tokens of a text."""
    bitmap_of, bits = seed_filter(items)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, low = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                h, row, begins = _tokens(c)
                for n in widths:
                    whole, place = K.window_hashes(h, row, n)
                    for value in _short_seeds(h, place, n):
                        hit = np.flatnonzero(holds(known, value & low))
                        if not len(hit):
                            continue
                        hit = hit[np.lexsort((place[hit], whole[hit], row[place[hit]]))]
                        at = place[hit]
                        new = np.ones(len(hit), bool)
                        new[1:] = (row[at[1:]] != row[at[:-1]]) | (whole[hit[1:]] != whole[hit[:-1]])
                        first = np.flatnonzero(new)
                        owner = row[at[first]]
                        rows = pa.array(owner + c.first)
                        run_of = (at[first][:, None] + np.arange(n)).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(value[hit[first]].view(np.int64)), K.list_array(_short(h[run_of]), np.arange(len(first) + 1) * n, pa.int32()), K.list_array((at - begins[row[at]]).astype(np.int32), np.append(first, len(at)), pa.int32())],
                            ["doc", "uid", "hash", "tokens", "starts"],
                        )

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc), text_key(doc, text).alias("uid"), F.col(text)).mapInArrow(run, f"doc {kind}, uid binary, hash bigint, tokens array<int>, starts array<int>")


def _short_overlaps(docs: DataFrame, items: DataFrame, widths: Sequence[int], doc: str, text: str) -> DataFrame:
    """Overlaps with items of ``widths`` tokens, as _verified() gives them."""
    seeds = items.filter(F.size("tokens") <= SHORT).select("item", F.col("tokens").alias("item_tokens"), F.explode("seeds.hash").alias("hash"))
    found = short_hits(docs, items, widths, doc, text).join(seeds, "hash").withColumn("n_tokens", F.size("item_tokens"))
    equal = F.aggregate(F.zip_with("tokens", "item_tokens", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)
    found = found.filter(F.size("tokens") == F.col("n_tokens")).withColumn("n_equal", equal).filter(F.col("n_equal") * WINDOW >= F.col("n_tokens") * FEWEST)
    return found.select("doc", "uid", "item", F.explode("starts").alias("token_start"), "n_tokens", "n_equal")


def _verified(found: DataFrame, kind: str, item_kind: str) -> DataFrame:
    """Alignments whose best window agrees well enough, from (doc, uid, item, diagonal, start, tokens, item_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diagonal, start = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            mine, theirs = batch.column(5), batch.column(6)
            lo, length, equal = (np.zeros(batch.num_rows, np.int32) for _ in range(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = mine[i].values.to_numpy(), theirs[i].values.to_numpy()
                lo[i] = max(diagonal[i], start[i])
                length[i] = min(diagonal[i] + len(b), start[i] + len(a)) - lo[i]
                width = min(WINDOW, len(b))
                if length[i] >= width:
                    at, other = lo[i] - start[i], lo[i] - diagonal[i]
                    sums = np.concatenate([[0], np.cumsum(a[at : at + length[i]] == b[other : other + length[i]])])
                    equal[i] = np.max(sums[width:] - sums[: len(sums) - width])
                    keep[i] = equal[i] * WINDOW >= width * FEWEST
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(lo), pa.array(length), pa.array(equal)]
            yield pa.RecordBatch.from_arrays(out, ["doc", "uid", "item", "token_start", "n_tokens", "n_equal"]).filter(pa.array(keep))

    found = found.select("doc", "uid", "item", "diagonal", "start", "tokens", "item_tokens")
    return found.mapInArrow(run, f"doc {kind}, uid binary, item {item_kind}, token_start int, n_tokens int, n_equal int")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: (doc, uid, item, token_start, n_tokens, n_equal); uid is a digest of id and text, for repeated and null ids.

    Tokens are runs of letters and digits, lower-cased; in scripts without spaces each character is one. A text overlaps an item if ``WINDOW`` aligned tokens (all of the
    item's, if it has fewer) agree in the share FEWEST / WINDOW. token_start is where the item's aligned part begins
    in the text, n_tokens that part's length, n_equal the agreeing tokens of its best window. Null or empty texts
    and items overlap nothing. Extra columns are ignored. Texts are read once more if there are items of at most SHORT tokens.
    """
    items = materialize(index_items(benchmark, item, item_text), "items")
    regions = materialize(scan(docs, items, doc, text), "regions")
    regions = regions.dropDuplicates(["uid", "start"])
    hits = regions.select("uid", "start", F.explode("hits").alias("hit")).select("uid", "start", F.col("hit.at").alias("at"), F.col("hit.hash").alias("hash"))
    seeds = items.select("key", F.explode("seeds").alias("seed")).select("key", F.col("seed.at").alias("seed_at"), F.col("seed.hash").alias("hash"))
    found = hits.join(seeds, "hash").select("uid", "start", "key", (F.col("at") - F.col("seed_at")).alias("diagonal")).distinct()
    found = found.join(regions.select("doc", "uid", "start", "tokens"), ["uid", "start"])
    found = found.join(items.select("item", "key", F.col("tokens").alias("item_tokens")), "key")
    checked = _verified(found, docs.schema[doc].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    # at most SHORT rows
    widths = sorted(r.n for r in items.select(F.size("tokens").alias("n")).filter(F.col("n").between(1, SHORT)).distinct().collect())
    if widths:
        checked = checked.union(_short_overlaps(docs, items, widths, doc, text))
    return checked.dropDuplicates(["doc", "uid", "item", "token_start"])


def mark(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """A row for each row of ``docs``: (its id, contaminated, n_items, n_overlaps, best_equal). Items count by id: several texts of one id are one, and so are all without an id."""
    doc, text = names.get("doc", "doc_id"), names.get("text", "text")
    with temporary(docs.sparkSession):
        by_doc = overlaps(docs, benchmark, **names).groupBy("uid").agg(F.countDistinct(F.struct("item")).alias("n_items"), F.count(F.lit(1)).alias("n_overlaps"), F.max("n_equal").alias("best_equal"))
        by_doc = materialize(by_doc, "marked", keep=True)
    keyed = docs.select(F.col(doc).alias("_doc"), text_key(doc, text).alias("uid"))
    joined = keyed.join(by_doc, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(F.col("_doc").alias(doc), F.col("n_overlaps").isNotNull().alias("contaminated"), zero("n_items"), zero("n_overlaps"), zero("best_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns; null and empty texts stay."""
    doc, text = names.get("doc", "doc_id"), names.get("text", "text")
    # written first, so that its size is known: few contaminated texts are broadcast and the others aren't shuffled
    with temporary(docs.sparkSession):
        bad = materialize(overlaps(docs, benchmark, **names).select(F.col("uid").alias("_uid")).distinct(), "contaminated", keep=True)
    return docs.join(bad, text_key(doc, text) == F.col("_uid"), "left_anti")
