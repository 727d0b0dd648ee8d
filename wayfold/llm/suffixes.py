"""Removal of repeated byte strings by suffix sorting.

Every string of ``LENGTH`` bytes that starts at two places is to be found. The strings' own bytes choose an anchor inside
each (the least hash among its ``GRAM``-byte grams), so that equal strings have equal anchors at equal places and one
record stands for all neighbouring strings with the same anchor: about one for every 80 bytes. Spark groups
the records by anchor and by context (the bytes of all strings that share the anchor). Suffixes are sorted deep-shallow: by
multikey quicksort on eight bytes at a time down to ``SHALLOW`` bytes, and what still agrees by blind tries. Of a context that seems to be there
several times two places are sorted, by the strings that it begins and ends with: if the bytes agree, all of it is repeated. At a repetition's
borders, where an anchor has other contexts besides one that stands alone, all strings of its contexts are sorted.

An anchor with more contexts than one task should sort is split by more bytes, as the sort itself would: its strings by ranges of their distance to the
anchor, and those of one range by the bytes that they all share. Equal strings stay together; the ranges shrink until the groups are small.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import kernels as K
from wayfold.llm.filters import among
from wayfold.llm.identity import text_key
from wayfold.llm.storage import materialize, temporary

#: Bytes of a string that counts as repeated, and of the grams that anchors are chosen from.
LENGTH, GRAM = 200, 40
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 32
#: Contexts that one task sorts together. Of an anchor with more, ranges of so many distances to the anchor are sorted apart, each by the bytes that its strings
#: share; a range of one distance shares all bytes.
GROUP, RANGES = 2048, (41, 11, 3, 1)
#: Bits that tell positions apart when grams compete: the same however long a text, so that equal strings have equal anchors.
PLACE_BITS = 34


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(c: K.Chunk) -> dict[str, np.ndarray] | None:
    """Anchors of a chunk: row, lo and hi (the context's bytes within the row), at (the anchor's offset in the context), and the hashes of gram and context."""
    n = len(c.data)
    if n < LENGTH:
        return None
    prefix = K.prefix_hash(c.data)
    at = np.arange(n - GRAM + 1)
    gram = K.range_hash(prefix, at, at + GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((gram & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)  # the leftmost of equal grams
    sizes = np.diff(c.offsets)
    room = np.zeros(n + 1, np.int32)  # 1 where a string fits into its row
    fits = sizes >= LENGTH
    np.add.at(room, c.offsets[:-1][fits], 1)
    np.add.at(room, c.offsets[1:][fits] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(room[: len(least)]))
    if not len(start):
        return None
    chosen = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    s0, s1, p = start[first], start[np.append(first[1:], len(start)) - 1], chosen[first]
    row = np.searchsorted(c.offsets, s0, "right") - 1
    base = c.offsets[row]
    context = K.mix(K.range_hash(prefix, s0, s1 + LENGTH) + (p - s0).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return {"row": row, "lo": s0 - base, "hi": s1 + LENGTH - base, "at": p - s0, "gram": gram[p], "context": context}


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0)
            for c in K.chunks(batch.column(1), K.DENSE):
                if a := anchors_of(c):
                    yield pa.RecordBatch.from_arrays(
                        [rid.take(pa.array(a["row"] + c.first)), *(pa.array(a[k].astype(np.int32)) for k in ("lo", "hi", "at")), pa.array(a["gram"].view(np.int64)), pa.array(a["context"].view(np.int64))],
                        ["rid", "lo", "hi", "at", "gram", "context"],
                    )

    return docs.select("rid", "text").mapInArrow(run, "rid binary, lo int, hi int, at int, gram bigint, context bigint")


# -- deep-shallow sorting ------------------------------------------------------------------------------------------------------


def _refine(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders by (group, key) and numbers the runs of equal pairs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, np.cumsum(new) - 1


def _quicksort(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_refine() for groups in order, by multikey quicksort: in every group at once, a key from its middle parts smaller, equal and larger ones.

    Equal ones are done at this depth; the others are parted again until every key has been a pivot.
    """
    run = np.zeros(len(group), np.int64)  # where the run of equal keys that each belongs to begins
    member = np.arange(len(group))
    base = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1] if len(group) else member
    while len(member):
        edge = np.r_[True, base[1:] != base[:-1]]
        first, part = np.flatnonzero(edge), np.cumsum(edge) - 1
        size = np.diff(np.r_[first, len(member)])
        own = key[member]
        pivot = own[first + size // 2][part]
        smaller, equal = own < pivot, own == pivot
        below, level = np.bincount(part, smaller).astype(np.int64)[part], np.bincount(part, equal).astype(np.int64)[part]
        base = base + np.where(smaller, 0, np.where(equal, below, below + level))
        run[member[equal]] = base[equal]
        member, base = member[~equal], base[~equal]
        order = np.argsort(base, kind="stable")
        member, base = member[order], base[order]
    order = np.argsort(run, kind="stable")
    return order, np.cumsum(np.r_[False, run[order][1:] != run[order][:-1]]) if len(run) else run


def _in_company(group: np.ndarray) -> np.ndarray:
    """Which members of sorted groups aren't alone."""
    same = group[1:] == group[:-1]
    out = np.zeros(len(group), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def repeated_suffixes(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Which suffixes data[start:] share their first ``length`` bytes with another suffix of their bucket.

    Multikey quicksort takes eight bytes for a character and drops suffixes that stand alone. At depth ``shallow`` the
    remaining groups become blind tries: along the path of one leaf, each other suffix is compared with it once and
    joins the child that its first different byte names; the children are tries again.
    """
    padded = np.zeros(len(data) + length + 8, np.uint8)
    padded[: len(data)] = data
    word = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
    out = np.zeros(len(start), bool)
    order, group = _refine(bucket, np.zeros(len(start), np.uint8))
    keep = _in_company(group)
    who, group = order[keep], group[keep]
    for depth in range(0, shallow, 8):
        order, group = _quicksort(group, word[start[who] + depth])
        keep = _in_company(group)
        who, group = who[order][keep], group[keep]
    steps = np.arange(0, length, 8)
    while len(who):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        leaf = who[first][np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        same = np.full(len(who), length)
        left = np.arange(len(who))
        for depth in steps:  # the first differing word, and in it the first differing byte
            a, b = word[start[who[left]] + depth], word[start[leaf[left]] + depth]
            differ = np.flatnonzero(a != b)
            x = (a ^ b)[differ]
            byte = 7 - np.floor(np.log2(np.maximum(x >> np.uint64(32), 1).astype(np.float64))).astype(np.int64) // 8 - 4
            low_half = (x >> np.uint64(32)) == 0
            byte[low_half] = 7 - np.floor(np.log2(x[low_half].astype(np.float64))).astype(np.int64) // 8
            same[left[differ]] = np.minimum(depth + byte, length)
            left = np.delete(left, differ)
            if not len(left):
                break
        equal = same >= length
        members = np.add.reduceat(equal.astype(np.int64), first)[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        out[who[equal & (members > 1)]] = True
        rest = np.flatnonzero(~equal)
        branch = same[rest] * 256 + padded[start[who[rest]] + same[rest]]
        order, number = _refine(group[rest], branch)
        keep = _in_company(number)
        who, group = who[rest][order][keep], number[keep]
    return out


def _runs(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags with one owner."""
    edge = np.r_[True, owner[1:] != owner[:-1]]
    begin = np.flatnonzero(flag & (edge | ~np.r_[False, flag[:-1]]))
    end = np.flatnonzero(flag & (np.r_[edge[1:], True] | ~np.r_[flag[1:], False]))
    return begin, end


def _strings(ctx: pa.Array, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of some contexts, all or only the first and last: the bytes, each string's start, its context, and where in it the string starts."""
    ctx = ctx.cast(pa.large_binary())
    off = np.frombuffer(ctx.buffers()[1], np.int64, len(ctx) + 1, ctx.offset * 8)
    data = np.frombuffer(ctx.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    last = np.diff(off) - LENGTH
    step = np.where(ends, np.maximum(last, 1), 1)
    n = last // step + 1
    owner = np.repeat(np.arange(len(ctx)), n)
    within = (np.arange(n.sum()) - np.repeat(K.starts(n)[:-1], n)) * step[owner]
    return data, off[owner] + within, owner, within


def _whole_buckets(table: pa.Table) -> Iterator[pa.Table]:
    """Runs of about GROUP rows of a table in order of its buckets, none of which is cut; the sort holds a dozen numbers for each byte of its rows."""
    bucket = table.column("bucket").to_numpy()
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    at = 0
    while at < len(bucket):
        to = int(edges[max(np.searchsorted(edges, at + GROUP, "right") - 1, np.searchsorted(edges, at, "right"))])
        yield table.slice(at, to - at)
        at = to


#: A context to be sorted: strings of one bucket meet; ``emits``: its repeated strings are asked for; ``ends``: by its first and last string; ``off``: where its
#: bytes begin in the whole context, ``at``: where the anchor lies in them.
_ROW = "bucket bigint, gram bigint, context bigint, emits boolean, ends boolean, off int, at int, ctx binary"
_COLUMNS = [f.split()[0] for f in _ROW.split(", ")]


def _sorted_spans(rows: DataFrame) -> DataFrame:
    """(gram, context, lo, hi): spans of repeated strings, relative to their context, of the rows that emit."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks()
        column = lambda name: batch.column(name).combine_chunks() if isinstance(batch.column(name), pa.ChunkedArray) else batch.column(name)
        flags = lambda name: column(name).to_numpy(zero_copy_only=False).astype(bool)
        data, start, owner, within = _strings(column("ctx"), column("at").to_numpy(), flags("ends"))
        bucket = column("bucket").to_numpy()
        number = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]])
        shift = column("at").to_numpy()[owner] - within
        flag = repeated_suffixes(data, start, number[owner] * (2 * LENGTH) + shift) & flags("emits")[owner]
        begin, end = _runs(flag, owner)
        o, off = owner[begin], column("off").to_numpy()
        rows_of = pa.array(o)
        return pa.RecordBatch.from_arrays([column("gram").take(rows_of), column("context").take(rows_of), pa.array((off[o] + within[begin]).astype(np.int32)), pa.array((off[o] + within[end] + LENGTH).astype(np.int32))], ["gram", "context", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut or held[0].column("bucket")[0].as_py() != bucket[-1]:
                table = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                yield from map(spans, _whole_buckets(table))
        if held:
            yield from map(spans, _whole_buckets(pa.Table.from_batches(held)))

    return rows.select(*_COLUMNS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "gram bigint, context bigint, b int, e int")


def _by_range(rows: DataFrame, width: int) -> DataFrame:
    """Rows for each range of ``width`` distances to the anchor, cut to the strings at these, in buckets of the bytes that the range's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at, ctx = r["at"], r["ctx"]
                for k in range((at - len(ctx) + LENGTH) // width, at // width + 1):
                    near, far = k * width, k * width + width - 1  # the range's least and greatest distance
                    begin, end = max(at - far, 0), min(at - near + LENGTH, len(ctx))
                    shared = ctx[at - near : at - far + LENGTH]
                    digest = hashlib.blake2b(shared, digest_size=8, key=struct.pack("<qq", r["bucket"], k)).digest()
                    out.append(r | {"bucket": struct.unpack("<q", digest)[0], "off": r["off"] + begin, "at": at - begin, "ctx": ctx[begin:end]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.select(*_COLUMNS).mapInArrow(run, _ROW)


def _in_small_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` in buckets of at most GROUP rows, but for a few more: larger ones are split by more and more of the bytes that equal strings share.

    When all are shared, the bucket is dealt out with one of its rows in each part. Rows without company go.
    """
    ready = None
    for width in RANGES:
        rows = materialize(_by_range(rows, width), f"range{width}")
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = rows.join(sizes, "bucket")
        small = sized.filter(F.col("n") <= GROUP).drop("n")
        ready = small if ready is None else ready.unionByName(small)
        rows = sized.filter(F.col("n") > GROUP)
        if rows.isEmpty():
            return ready
        if width > 1:
            rows = rows.drop("n")
    parts = F.ceil(F.col("n") / GROUP)
    one = rows.groupBy("bucket").agg(F.min_by(F.struct(*(c for c in _COLUMNS if c != "bucket")), "context").alias("one"), F.max(parts).alias("parts"))
    part = lambda i: F.xxhash64("bucket", i)
    dealt = rows.withColumn("bucket", part(F.pmod(F.xxhash64("context", "gram"), parts))).drop("n")
    again = one.select("bucket", "one.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i")).withColumn("bucket", part(F.col("i"))).withColumn("emits", F.lit(False))
    return ready.unionByName(dealt.select(*_COLUMNS)).unionByName(again.select(*_COLUMNS))


# -- the operator --------------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, rid, text): rid is a 128-bit digest of id and text."""
    return docs.select(F.col(doc).alias("doc"), text_key(doc, text).alias("rid"), F.col(text).alias("text"))


def _touched(keyed: DataFrame, rids: DataFrame) -> DataFrame:
    """(rid, text) of texts whose rid is among ``rids``, and of a few more."""
    return among(keyed.filter(F.col("text").isNotNull()).select("rid", "text"), rids.select("rid"), "rid")


def repeated_spans(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, lo, hi): byte spans of texts that consist of repeated strings; they may overlap. rid is a digest of id and text.

    Null and short texts have none. Rows that agree in id and text share a rid and repeat one another.
    """
    keyed = _keyed(docs, doc, text)
    with temporary(docs.sparkSession):
        anchors = materialize(_anchors(keyed), "anchors")
        contexts = anchors.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"))
        grams = contexts.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest")).filter("total > 1")
        seen = contexts.join(grams, "gram").select("gram", "context", "n", "kinds", ((F.col("fewest") == 1) & (F.col("kinds") > 1)).alias("borders"))
        found = materialize(anchors.join(seen, ["gram", "context"]), "found", keep=True)

    place = F.struct("rid", "lo", "hi", "at")
    cut = found.groupBy("gram", "context").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.max("n").alias("n"), F.max("kinds").alias("kinds"), F.bool_or("borders").alias("borders"))
    often = F.col("n") > 1
    row = lambda p, emits, ends, when: F.when(when, F.struct(F.col(f"{p}.rid").alias("rid"), F.struct("gram", "context", "kinds", emits.alias("emits"), F.lit(ends).alias("ends"), F.col(f"{p}.lo").alias("lo"), F.col(f"{p}.hi").alias("hi"), F.col(f"{p}.at").alias("at")).alias("cut")))
    cut = cut.select(F.explode(F.array_compact(F.array(row("one", ~often, False, F.col("borders")), row("one", F.lit(True), True, often), row("other", F.lit(False), True, often)))).alias("x")).select("x.*")
    with temporary(docs.sparkSession):
        cuts = materialize(cut.groupBy("rid").agg(F.collect_list("cut").alias("cuts")), "cuts")  # a text's own anchors
        texts = _touched(keyed, cuts).dropDuplicates(["rid"]).join(cuts, "rid")
        cut = texts.select(F.encode("text", "utf-8").alias("bytes"), F.explode("cuts").alias("cut"))
        pieces = materialize(cut.select("cut.*", F.substring(F.col("bytes"), F.col("cut.lo") + 1, F.col("cut.hi") - F.col("cut.lo")).alias("ctx")), "pieces", keep=True)
    bucket = F.when(F.col("ends"), F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    rows = pieces.withColumn("bucket", bucket).withColumn("off", F.lit(0))
    many = ~F.col("ends") & (F.col("kinds") > GROUP)
    few, many = rows.filter(~many).select(*_COLUMNS), rows.filter(many).select(*_COLUMNS)
    sorted_rows = few if many.isEmpty() else few.unionByName(_in_small_buckets(many))
    told = found.join(_sorted_spans(sorted_rows), ["gram", "context"])
    return told.select("rid", (F.col("lo") + F.col("b")).alias("lo"), (F.col("lo") + F.col("e")).alias("hi"))


def _cut_out(texts: DataFrame) -> DataFrame:
    """Of (rid, text, spans): rid, n_removed, n_spans, kept (the bytes left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            lo, hi, off = (x.to_numpy() for x in (spans.values.field(0), spans.values.field(1), spans.offsets))
            removed, n_spans, kept, digest = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, lo[off[i] : off[i + 1]], 1)
                np.add.at(edge, hi[off[i] : off[i + 1]], -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(raw[~gone].tobytes())
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["rid", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.mapInArrow(run, "rid binary, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def _changed(keyed: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    with temporary(docs.sparkSession):
        spans = repeated_spans(docs, doc=doc, text=text)
        by_text = materialize(spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans", keep=True)
    texts = _touched(keyed, by_text).dropDuplicates(["rid"]).join(by_text, "rid")
    return _cut_out(texts.select("rid", F.encode("text", "utf-8").alias("text"), "spans"))


def remove_repeats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): for each row of ``docs`` the bytes left when every byte of a repeated string is gone; binary, as a cut may split a character."""
    keyed = _keyed(docs, doc, text)
    changed = _changed(keyed, docs, doc, text).select("rid", "kept")
    whole = keyed.join(changed, "rid", "left")
    return whole.select(F.col("doc").alias(doc), F.coalesce("kept", F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("kept"))


def digests(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``LENGTH`` bytes that covers it also starts elsewhere in any text, the same one
    included. Strings never cross texts. Null counts as empty. Further columns are ignored.
    """
    keyed = _keyed(docs, doc, text)
    changed = _changed(keyed, docs, doc, text).drop("kept")
    full = F.coalesce("text", F.lit(""))
    plain = keyed.select("doc", "rid", F.octet_length(full).cast("long").alias("n_bytes"), F.sha2(full, 256).alias("sha"))
    rows = plain.join(changed, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("doc").alias(doc), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
