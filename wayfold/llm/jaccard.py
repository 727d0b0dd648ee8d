"""Exact n-gram Jaccard self-join by a token-group matrix.

Texts become sets of hashed word shingles and equal sets become one class. A class enters the matrix under the tokens of
its prefix only: its rarest tokens, as many as two sets of the wanted similarity must share one of. Classes that the prefixes
bring together are first compared with one leader for each token and so grown into groups of linked classes.
Then the token-group matrix decides what is left: for each class and each foreign group under one of its tokens, the
group's token union bounds the overlap with any member, and only groups that can reach the threshold are opened.
Links inside a group never have to be found, since the group is connected already: copies in thousands
cost thousands of comparisons, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import kernels as K
from wayfold.llm.components import components
from wayfold.llm.filters import among
from wayfold.llm.storage import materialize, temporary

#: Buckets of the token frequency sketch: its size doesn't depend on the corpus.
SKETCH_BITS = 18
#: Members whose token union is one column of the matrix.
GROUP = 32
#: Tokens in buckets of the sketch with more than so many times the mean count may stand in very many prefixes.
FREQUENT = 64


def shingle_sets(c: K.Chunk, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of k words in a row; fewer words are one shingle, no words none."""
    w = K.words(c)
    h = K.word_hashes(c, w)
    windows, at = K.window_hashes(h, w.doc, k)
    bounds = K.starts(np.bincount(w.doc[at], minlength=c.rows))
    begins = K.starts(w.per_doc)
    for i in range(c.rows):
        if bounds[i + 1] > bounds[i]:
            yield np.unique(windows[bounds[i] : bounds[i + 1]])
        elif w.per_doc[i]:
            value = np.full(1, int(w.per_doc[i]), np.uint64)
            for x in h[begins[i] : begins[i + 1]]:
                value = value * np.uint64(0x9FB21C651E98DF25) + x
            yield K.mix(value)
        else:
            yield windows[:0]


def _sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Counts of all documents' tokens by hash bucket: 2**SKETCH_BITS numbers. They only order tokens, rare before frequent."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for c in K.chunks(batch.column(0), K.DENSE):
                sets = [*shingle_sets(c, k)]
                total += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return out


def _ceil(n: Column | np.ndarray, num: int, den: int):
    return (n * num + (den - 1)) // den


def _signed(docs: DataFrame, doc: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(doc, n, sig_a, sig_b, prefix, frequent): set size, 128 bits of hash of the set, its probing prefix, rarest tokens first, and where in it frequent tokens begin."""
    counted = _sketch(docs, text, k)
    often = FREQUENT * (int(counted.mean()) + 1)
    sketch = docs.sparkSession.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low = sketch.value, np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for c in K.chunks(batch.column(1), K.DENSE):
                n, sig, prefixes = np.zeros(c.rows, np.int64), np.zeros((2, c.rows), np.uint64), []
                frequent = np.zeros(c.rows, np.int32)
                for i, s in enumerate(shingle_sets(c, k)):
                    n[i] = len(s)
                    if len(s):
                        sig[0, i], sig[1, i] = np.sum(K.mix(s + np.uint64(0x51ED2701))), np.sum(K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                        keep = len(s) - _ceil(len(s), num, den) + 1
                        count = counts[(s & low).astype(np.int64)]
                        order = np.argsort(count, kind="stable")[:keep]
                        prefixes.append(s[order])
                        frequent[i] = np.searchsorted(count[order], often, "right")
                lengths = np.where(n > 0, n - _ceil(n, num, den) + 1, 0)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(n), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), K.list_array(flat.view(np.int64), K.starts(lengths), pa.int64()), pa.array(frequent)], ["doc", "n", "sig_a", "sig_b", "prefix", "frequent"])

    return docs.select(doc, text).mapInArrow(run, f"doc {docs.schema[doc].dataType.simpleString()}, n bigint, sig_a bigint, sig_b bigint, prefix array<bigint>, frequent int")


def _sets(docs: DataFrame, ids: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(node, tokens): the whole sets of the documents whose id is among ``ids``, and of a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1), K.DENSE):
                sets = list(shingle_sets(c, k))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), K.list_array(flat.view(np.int64), K.starts(np.array([len(s) for s in sets], np.int64)), pa.int64())], ["node", "tokens"])

    texts = docs.select(F.col(doc).alias("node"), F.col(text).alias("text"))
    return among(texts, ids, "node", run, f"node {docs.schema[doc].dataType.simpleString()}, tokens array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, doc: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets are similar enough, by the exact intersection of the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            va, vb = a.values.to_numpy(), b.values.to_numpy()
            oa, ob = a.offsets.to_numpy(), b.offsets.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    kind = docs.schema[doc].dataType.simpleString()
    with temporary(docs.sparkSession):
        pairs = materialize(pairs, "pairs")
        sets = materialize(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), doc, text, k), "sets")
        left = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        both = left.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        return materialize(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, f"a {kind}, b {kind}"), "links", keep=True)


def _indexed(n: Column, num: int, den: int) -> Column:
    """How many tokens the prefix of a set of size n holds for partners that are no smaller."""
    return F.floor(n - F.ceil(n * (2 * num) / (num + den)) + 1)


def _probing(n: Column, num: int, den: int) -> Column:
    """How many tokens the whole prefix holds."""
    return F.floor(n - F.ceil(n * num / den) + 1)


def _fit(n: Column, m: Column, num: int, den: int) -> Column:
    """Whether sets of sizes n and m can be similar enough."""
    return (n * den >= m * num) & (m * den >= n * num)


def _reach(n: Column, n_at: Column, m: Column, m_at: Column, num: int, den: int) -> Column:
    """Whether what two sets still share from this first common token on can be enough."""
    return F.least(n - n_at, m - m_at) * (num + den) >= (n + m) * num


def _entries(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n, at, leader, leader_n, leader_at): prefix tokens where classes meet, each with the token's leader.

    The leader is a class that has the token in its indexing prefix, if there is one, and of those the one with the
    fewest rarer tokens: among copies with small changes that is the copy changed least, which most others are near to.
    """
    rows = classes.select("node", "n", "frequent", F.posexplode("prefix").alias("at", "token"))
    # size and place in one number: these rows are the largest shuffle
    where = F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("where")
    rows = rows.select("token", "node", where, (F.col("at") >= F.col("frequent")).alias("often"))
    n, at = F.shiftright("where", 32), F.col("where").bitwiseAND(F.lit((1 << 32) - 1))
    best = F.min(F.struct((at >= _indexed(n, num, den)).alias("late"), at.alias("at"), "where", "node"))
    under = W.partitionBy("token")
    plain = rows.filter(~F.col("often")).drop("often")
    met = plain.select("*", best.over(under).alias("leader"), F.count(F.lit(1)).over(under).alias("meet")).filter("meet > 1")
    # under a frequent token may stand a third of all rows: leaders by an aggregate that adds up before the shuffle, then a join that can be split
    hot = materialize(rows.filter("often").drop("often"), "frequent")
    led_by = materialize(hot.groupBy("token").agg(best.alias("leader"), F.count(F.lit(1)).alias("meet")).filter("meet > 1"), "leaders")
    met = met.unionByName(hot.join(led_by, "token"))
    led = F.col("leader.where")
    return met.select("token", "node", n.alias("n"), at.alias("at"), F.col("leader.node").alias("leader"), F.shiftright(led, 32).alias("leader_n"), led.bitwiseAND(F.lit((1 << 32) - 1)).alias("leader_at"))


def _bounded(common: Column, n: Column, m: Column, most: Column, num: int, den: int) -> Column:
    """Whether sets of sizes n and m (at least) can be similar enough if their prefixes share ``common`` tokens.

    Up to the end of the prefix that ends first, all they share is in both prefixes; beyond it at most that set's rest, which is no more than ``most``'s rest.
    """
    return (common + most - _probing(most, num, den)) * (num + den) >= (n + m) * num


def _plausible(pairs: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that share enough prefix tokens."""
    one = entries.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "token")
    other = entries.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "token")
    common = pairs.join(one, "a").join(other, ["b", "token"]).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    return common.filter(_bounded(F.col("common"), F.col("n_a"), F.col("n_b"), F.greatest("n_a", "n_b"), num, den)).select("a", "b")


def _across(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that may link classes of different groups, by the token-group matrix.

    A column of the matrix is a part of a group: about GROUP members of nearly one size. A cell counts the query's
    prefix tokens in the column's token union, and so bounds what the query shares with any member. Columns that can
    reach the threshold are opened: the query meets their members.
    """
    # sizes within a tenth, dealt by hash: no group's members have to be ordered in one task
    member = materialize(placed.select("node", "n", "component", F.floor(F.log(1.1, F.col("n"))).alias("band")).distinct(), "members")
    parts = member.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    column = F.col("band") * (1 << 40) + F.pmod(F.xxhash64("node"), F.col("parts"))
    member = materialize(member.join(materialize(parts, "parts"), ["component", "band"]).select("node", "n", "component", column.alias("column")), "columns")
    placed = placed.join(member.select("node", "column"), "node")
    matrix = placed.groupBy("token", "component", "column").agg(F.min("n").alias("m_min"), F.max("n").alias("m_max"), F.min(F.when(F.col("at") < _indexed(F.col("n"), num, den), F.col("at"))).alias("m_at"))
    query = placed.select("token", "node", "n", "at", F.col("component").alias("own"))
    # a pair is found from its larger set, under a token of the smaller one's indexing prefix
    fit = (F.col("component") != F.col("own")) & (F.col("m_min") <= F.col("n")) & (F.col("m_max") * den >= F.col("n") * num)
    fit &= F.least(F.col("n") - F.col("at"), F.col("m_max") - F.col("m_at")) * (num + den) >= (F.col("n") + F.col("m_min")) * num
    cells = query.join(matrix.filter("m_at is not null"), "token").filter(fit).select("node", "component", "column").distinct()
    common = cells.join(placed.select("node", "n", "token"), "node").join(matrix, ["component", "column", "token"])
    counted = common.groupBy("node", "n", "component", "column").agg(F.count(F.lit(1)).alias("common"), F.min("m_min").alias("m_min"))
    # written, so that this plan and that of the opened columns are two
    reached = materialize(counted.filter(_bounded(F.col("common"), F.col("n"), F.col("m_min"), F.col("n"), num, den)).select("node", "n", "component", "column"), "reached")
    opened = reached.join(member.select(F.col("node").alias("b"), F.col("n").alias("m"), "component", "column"), ["component", "column"])
    pairs = opened.filter(_fit(F.col("n"), F.col("m"), num, den) & (F.col("m") <= F.col("n"))).select(F.col("node").alias("a"), "b")
    return _plausible(pairs.distinct(), placed, num, den)


def _named_components(named: DataFrame, docs: DataFrame, doc: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(sig_a, sig_b, component): each class of equal sets and the least id that links reach from it."""
    classes = named.groupBy("sig_a", "sig_b").agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("frequent").alias("frequent"))
    entries = materialize(_entries(classes, num, den), "entries")

    led = (F.col("leader_at") < _indexed(F.col("leader_n"), num, den)) & (F.col("node") != F.col("leader"))
    stars = entries.filter(led & _reach(F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at"), num, den) & _fit(F.col("n"), F.col("leader_n"), num, den))
    stars = stars.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = _verified(_plausible(stars, entries, num, den), docs, doc, text, k, num, den)
    groups = materialize(components(first), "groups")

    # what is left: a class and a group under the same token that aren't connected yet
    placed = entries.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("token")
    placed = materialize(placed.join(open_tokens, "token"), "placed")
    second = _verified(_across(placed, num, den), docs, doc, text, k, num, den)
    whole = components(first.union(second))

    return named.groupBy("sig_a", "sig_b").agg(F.min("doc").alias("node")).join(whole, "node", "left").select("sig_a", "sig_b", F.coalesce("component", "node").alias("component"))


def linked(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each row of ``docs``: (doc_id, n_shingles, component_id).

    Words are runs without ASCII white space, A-Z lower-cased. Documents link when den * |intersection| >= num *
    |union| of their sets of k-word shingles (a text with fewer words is one shingle). component_id is the
    least id that links reach, the own id included. Null or empty texts have n_shingles 0 and stay alone.
    Equal texts always share a component, also under one repeated id. A null id never names a component
    and stays alone unless its set is a named document's too. Ids may be of any type that orders. An empty table gives an empty one;
    further columns are ignored.
    """
    signed = materialize(_signed(docs, doc, text, k, num, den), "signed")
    named = signed.filter((F.col("n") > 0) & F.col("doc").isNotNull())
    with temporary(docs.sparkSession):
        # a table of its own, so that the join below is one of plain scans: the rows of a large class of copies can be split
        ids = materialize(_named_components(named, docs, doc, text, k, num, den), "ids", keep=True)
    rows = signed.select("doc", "n", "sig_a", "sig_b").join(ids, ["sig_a", "sig_b"], "left")
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"))


def keep_one(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row of each group of linked rows, with all columns: the one with the smallest id.

    Rows that share an id count as one group too; of those any one stays. Texts without words and rows with a null id stay.
    The ids to leave out are written first, so that their size is known: where they are few they are broadcast and no text is shuffled.
    """
    groups = linked(docs, doc=doc, text=text, **options).filter(F.col("doc_id").isNotNull())
    ids = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
    out = materialize(ids.filter((F.col("n") > 1) | ~F.col("first")).select(F.col("doc_id").alias("_out"), (F.col("first") & (F.col("n") > 1)).alias("_again")), "left_out")
    kept = docs.join(out, F.col(doc) == F.col("_out"), "left_anti")
    again = out.filter("_again").select("_out")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, F.col(doc) == F.col("_out"), "left_semi").dropDuplicates([doc]))
