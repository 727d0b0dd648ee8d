"""Each operator against a brute-force version or a round trip on the smallest tables, and on rows that break things."""

import collections
import hashlib
import itertools
import math
import re
import threading
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import chat, decontam, filters, folds, importance, jaccard, langid, mixing, neighbours, quality, queries, repair, rules, sharding, storage, suffixes, toxicity
from wayfold.llm import kernels as K
from wayfold.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 3000 + "ünïcode " * 50


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use themselves."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, same, "en", "a"), (1, same, "en", "a"), (2, same, None, None), (3, None, "en", "a"), (4, "", "en", "b"), (None, same, "de", "a"), (5, LONG, "en", "b"), (6, "   \n\t ", "fr", "a"), (7, "x", "en", "a"), (None, None, None, None)]
    rows = [(*r, i, "t", 1.5, "q") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, token string, component double, rid string")


def empty(df):
    return df.limit(0)


def test_one_query_for_each_operator():
    assert sorted(n.split("_")[0] for n in queries.queries()) == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)


def _auc(score, label):
    """The chance that a row of label 1 has a higher score than one of label 0, ties half."""
    score, label = np.asarray(score), np.asarray(label)
    ones, zeros = score[label == 1][:, None], score[label == 0][None, :]
    return float((ones > zeros).mean() + (ones == zeros).mean() / 2)


def test_folds_are_crc32_of_the_id(spark):
    got = [r.f for r in spark.createDataFrame([(0,), (12,), (-7,), (None,)], "doc_id long").select(folds.fold(F.col("doc_id"), 4).alias("f")).collect()]
    assert got == [zlib.crc32(x) % 4 for x in (b"0", b"12", b"-7", b"")]


def test_labelled_sample_depends_on_rows_alone(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " * (1 + i % 5)) for i in range(120)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(100)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    pick = lambda n, **o: [tuple(r) for r in folds.labelled_sample(docs.repartition(n), labels.repartition(n), "toxic", 20, **o).collect()]
    assert pick(1) == pick(7) and len(pick(1)) <= 20
    assert sum(len(t) for t, _ in pick(3, most_bytes=100)) <= 100 and len(pick(3, most_bytes=1)) == 1


# -- 1, 4, 6: classifiers, by held-out accuracy -----------------------------------------------------------------------------------


def test_toxicity_held_out_and_odd(spark, docs, odd):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_string_kernel_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    # by class, as toxic texts are few; some labels have no trace in their texts
    assert held.predicted[held.toxic == 1].mean() > 0.9 and held.predicted[held.toxic == 0].mean() < 0.02 and _auc(held.score, held.toxic) > 0.95
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(odd, empty(labels))):
        scores = [r.score for r in toxicity.score(odd, model).collect()]
        assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(empty(odd), model).count() == 0


def test_string_kernel_by_definition():
    """Landmark weights give the same as summing over all pairs of subsequences."""
    words = [b"\x01\x02\x03\x04", b"\x01\x05\x02\x03", b"\x04\x04\x03\x01\x02"]

    def brute(s, t):
        total = 0.0
        for i, j in itertools.product(itertools.combinations(range(len(s)), 3), itertools.combinations(range(len(t)), 3)):
            if [s[x] for x in i] == [t[x] for x in j]:
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    norm = lambda s: math.sqrt(sum(toxicity.DECAY ** (2 * (i[-1] - i[0] + 1)) for i in itertools.combinations(range(len(s)), 3)))
    for s, t in itertools.product(words, words):
        weights = np.zeros(toxicity.CLASSES**3, np.float32)
        np.add.at(weights, toxicity.codes(np.frombuffer(t, np.uint8)[None])[0], toxicity.subsequences(len(t))[1])
        got = toxicity.margins(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]), weights)[0]
        assert got == pytest.approx(brute(s, t) / norm(s) / norm(t), rel=1e-5)


def test_spelled_out_words_are_read():
    c = next(K.chunks(pa.array(["so i d i o t now", "st-up.id", "tr4sh 123"])))
    s = toxicity.spell(c)
    read = ["".join(chr(96 + x) for x in s.letters[a:b]) for a, b in zip(s.start, s.end)]
    assert {"idiot", "stupid", "trash", "so", "now"} <= set(read) and "oie" not in read


def test_language_held_out_and_odd(spark, docs, odd):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_centroid_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert ((got.lang_pred == got.lang)[got.held_out]).mean() > 0.98
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, langid.train(odd)).collect()]
    assert len(out) == 10 and {x[1] for x in out if x[0] in (3, 4, 6)} == {"und"} and all(0 <= x[2] <= 1 for x in out)
    assert {r.lang_pred for r in langid.predict(odd, langid.train(empty(odd))).collect()} == {"und"}
    numbers = spark.createDataFrame([(1, "123 ...", "en"), (2, "ß", "de"), (3, "、。", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred == "und" for r in langid.predict(numbers, langid.train(docs)).orderBy("doc_id").collect()] == [True, False, True]


def test_quality_held_out_and_odd(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_neighbour_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held.predicted[held.quality == 1].mean() > 0.97 and held.predicted[held.quality == 0].mean() < 0.2 and _auc(held.score, held.quality) > 0.98
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for model in (quality.train(odd, labels), quality.train(odd, empty(labels))):
        scores = [r.score for r in quality.score(odd, model).collect()]
        assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)


def _trigram_vector(text, model_idf, gram=3, bits=13):
    """TF-IDF of hashed byte trigrams, one by one, scaled to length one."""
    data = text.encode()
    counts = collections.Counter((int.from_bytes(data[i : i + gram], "big") + 1) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - bits for i in range(len(data) - gram + 1))
    v = {f: (1 + math.log(n)) * float(model_idf[f]) for f, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {f: x / norm for f, x in v.items()}


def test_language_cosines_by_definition(spark, docs):
    model = langid.train(docs)
    plain = lambda t: re.sub("[^a-z\u0080-\uffff]+", " ", t.lower()).lstrip(" ")
    rows = [r for r in docs.filter("length(text) between 40 and 4000").orderBy("doc_id").limit(25).collect()]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        v = _trigram_vector(plain(r.text), model.idf)
        cosine = [sum(x * float(c[f]) for f, x in v.items()) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert got[r.doc_id].cosine == pytest.approx(cosine[best], abs=2e-4)
        ranked = sorted((max(c for c, o in zip(cosine, model.owner) if o == i) for i in range(len(model.languages))), reverse=True)
        if ranked[0] - ranked[1] > 1e-3:
            assert got[r.doc_id].lang_pred == model.languages[model.owner[best]]
            assert got[r.doc_id].score == pytest.approx(0.5 + 0.5 * (ranked[0] - ranked[1]) / ranked[0], abs=1e-3)
        if abs(cosine[best] - model.radius[best]) > 1e-3:
            assert got[r.doc_id].rejected == (cosine[best] < model.radius[best])
    far = spark.createDataFrame([(1, "qxzq wvkj zzxq jjqw " * 20, "en")], "doc_id long, text string, lang string")
    assert langid.predict(far, model).first().rejected
    norms = np.linalg.norm(model.centroids, axis=1)
    assert np.allclose(norms, 1, atol=1e-4) and all(collections.Counter(model.owner)[i] <= langid.CENTROIDS for i in range(len(model.languages)))


def test_neighbours_vote_by_definition(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.filter("length(text) > 30").orderBy("doc_id").limit(30).collect():
        chunk = next(K.chunks(pa.array([r.text])))
        row, feature, value = quality._weighted(chunk)
        x = sum(float(v) * model.basis[f].astype(float) for f, v in zip(feature, value))
        x = x / max(np.linalg.norm(x), 1e-12)
        near = sorted(((float(x @ v), float(y)) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        if near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0] < 1e-5:
            continue  # a tie at the edge
        weight = [max(c, 1e-3) ** quality.POWER for c, _ in near[: quality.NEIGHBOURS]]
        assert got[r.doc_id] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs=2e-3)


# -- 2 --------------------------------------------------------------------------------------------------------------------------


def _chat_expected(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        yield conv, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nasty = ["&lt;|x", "<|im_end|>\n", "</s>[INST] ok [/INST]", "&amp;lbrack;", "<", "[", "&", "a\nb", "", None, "é" * 40]
    rows += [(-5, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty * 15)]
    rows += [(-6, 0, "system", "be brief")] + [(-6, i, "assistant", "w " * (i * 37 % 300)) for i in range(1, 200)]
    rows += [(-7, None, None, None), (-7, 1, "assistant", "x"), (-7, 1, "assistant", "x"), (None, 0, "a\nb<|", "t"), (-8, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, span int")
    windows = chat.format_windows(df, budget=256, history_turns=2, history_tokens=64)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == dict(_chat_expected(rows))
    for w in windows.filter("conv_id = -6").collect():
        assert w.formatted.startswith("<|im_start|>system\nbe brief") and (w.n_tokens <= 256 or w.n_turns - w.n_repeated == 1)
    assert chat.digests(chat.format_windows(empty(df))).count() == 0


def test_chat_windows_follow_the_sql_at_any_length(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i * 100, ("user", "assistant")[i % 2], "w " * int(rng.integers(1, 9))) for i in range(70)]
    rows += [(2, i, "system" if i == 0 else ("user", "assistant")[i % 2], "v " * int(rng.integers(1, 150))) for i in range(300)]
    rows += [(3, i, "assistant", "u " * int(rng.integers(20, 400))) for i in range(63, 131)] + [(None, i, "user", "n " * 30) for i in range(200)]
    rows += [(4, i, ("system", "user", "assistant")[min(i, 2)], "x " * n) for i, n in enumerate((3, 380, 50, 400, 60, 60, 300))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(w.conv_id, w.window): (w.n_turns, w.n_repeated, w.n_tokens) for w in chat.format_windows(df).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2], len(r[3].split()) + 4) for r in rows if r[0] == conv]
        system = turns[0][1] if turns[0][0] == "system" else 0
        starts, used = [], 0
        for i, (_, n) in enumerate(turns):
            if i == 0 or used + n > max(384 - system, 1):
                starts.append(i)
                used = 0
            used += n
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(turns)])):
            history = []
            for i in range(a - 1, max(a - 3, -1 if not system else 0), -1):
                if sum(history) + turns[i][1] > 128:
                    break
                history.append(turns[i][1])
            repeated = ([system] if system and k else []) + history
            want[conv, k] = (len(repeated) + b - a, len(repeated), sum(repeated) + sum(n for _, n in turns[a:b]))
    assert got == want
    duckdb = pytest.importorskip("duckdb").connect()
    conversations = df.filter("conv_id is not null").toPandas()
    duckdb.register("conversations", conversations)
    sql = {r[0]: r[1:] for r in duckdb.sql(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({queries._OP2}) where conv_id > 0").fetchall()}
    mine = chat.digests(chat.format_windows(df.filter("conv_id is not null"))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in mine} == sql


# -- 3 --------------------------------------------------------------------------------------------------------------------------


def test_shards_move_only_into_the_new_one(spark, odd):
    rows = [r.asDict() for r in queries.op3_rendezvous_shards(spark, SF).collect()]
    assert len(rows) == 200 and all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    n = collections.Counter(r.shard for r in sharding.assign_shards(keys, "doc_id", [1.0, 1.0, 2.0]).collect())
    assert n[2] == pytest.approx(10000, rel=0.05) and n[0] == pytest.approx(5000, rel=0.08)
    out = sharding.number_slots(sharding.assign_shards(odd, "doc_id", [1.0] * 4), "shard", ["doc_id", "text"]).collect()
    assert len(out) == 10 and {c for c in out[0].asDict()} == {*odd.columns, "slot"}
    assert sharding.assign_shards(empty(odd), "doc_id", [1.0]).count() == 0


# -- 5 --------------------------------------------------------------------------------------------------------------------------


def _sets(texts):
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        yield {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _components(ids, sets, num=80, den=100):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip(ids, sets), 2):
        if s and t and den * len(s & t) >= num * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_jaccard_against_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    more = []
    for i in range(120):  # many changed copies of one text, some near to it, some only to each other
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            words[at] = f"x{rng.integers(0, 40)}"
        more.append((10_000 + i, " ".join(words)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = df.collect()
    sets = list(_sets(r.text for r in rows))
    want = _components([r.doc_id for r in rows], sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(df).collect()}
    assert got == {r.doc_id: (len(s), want[r.doc_id]) for r, s in zip(rows, sets)}


def test_jaccard_odd(odd):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(odd).collect())
    assert got[(1, 8, 1)] == 2 and got[(2, 8, 1)] == 1 and got[(None, 8, 1)] == 1
    assert got[(3, 0, 3)] == got[(4, 0, 4)] == got[(6, 0, 6)] == got[(7, 1, 7)] == got[(None, 0, None)] == 1
    assert jaccard.linked(empty(odd)).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(odd).collect()) == [0, 0, 1, 3, 4, 5, 6, 7]


def test_whole_sets_take_one_worker_for_each_task(spark, docs, monkeypatch):
    # a second mapInArrow in a stage has workers of its own, and an executor keeps them all
    ids = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("node"))
    want = {r.doc_id: len(s) for r, s in zip(docs.collect(), _sets(r.text for r in docs.collect())) if r.doc_id % 3 == 0}
    for most in (filters.MOST, 0):  # by a bitmap, and by a semi-join
        monkeypatch.setattr(filters, "MOST", most)
        found = jaccard._sets(docs, ids, "doc_id", "text", 5)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        got = {r.node: len(set(r.tokens)) for r in found.collect()}
        assert {i: got[i] for i in want} == want and (most or got == want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


# -- 7 --------------------------------------------------------------------------------------------------------------------------


def _statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(marked)


def test_rules_against_brute_force(docs, odd):
    for df in (docs, odd):
        rows = rules.judge(df, carry=["doc_id", "text"], reuse=False).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = _statistics(r.text)
            assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert rules.judge(empty(odd)).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def test_every_trigram_is_counted(spark):
    """No cap: in rows of every length, over many batches and more languages than a task holds tables for, all trigrams of byte classes."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc é\n1#"), int(n))) for n in rng.integers(0, 400, 300)] + ["x" * 400_000, "", "ab", "abc"]
    rows = [(f"l{i % 11}", t) for i, t in enumerate(texts)]
    want = collections.Counter()
    for name, t in rows:
        x = rules._CLASS[np.frombuffer(t.encode(), np.uint8)].tolist()
        want.update((name, a << 14 | b << 7 | c) for a, b, c in zip(x, x[1:], x[2:]))
    got = rules.count_trigrams(spark.createDataFrame(rows, "lang string, text string"), F.col("lang")).collect()
    assert {(r.lang, r.code): r.n for r in got} == want and len(got) == len(want)


def test_a_carried_text_goes_to_the_workers_once(spark, docs):
    measured = rules.measure(docs, None, F.lit("*"), carry=["doc_id", "text", "lang"])
    sent = measured._jdf.queryExecution().optimizedPlan().children().head().output().size()
    assert sent == 4 and measured.columns[:3] == ["doc_id", "text", "lang"]
    assert sorted(measured.select("doc_id", "text", "lang").collect(), key=str) == sorted(docs.select("doc_id", "text", "lang").collect(), key=str)


def test_kneser_ney_sums_to_one(docs):
    model = rules.train(docs, F.lit("*"))
    classes = np.unique(rules._CLASS)
    for context in ((ord("t") - 30, ord("h") - 30), (5, 9)):
        code = (context[0] << 14) | (context[1] << 7) | np.arange(1 << 7)
        total = np.exp(model.log_probability("*", code)).sum()
        assert total == pytest.approx(1, abs=0.03), (context, len(classes))


def _kneser_ney(texts):
    """log P of byte-class trigrams from the definition, and their codes."""
    grams = lambda t: [tuple(int(rules._CLASS[b]) for b in t[i : i + 3]) for i in range(len(t) - 2)]
    three = collections.Counter(g for t in texts for g in grams(t.encode()))
    two = collections.Counter(g[1:] for g in three)
    one = collections.Counter(g[1:] for g in two)

    def level(counts):
        of = collections.Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.5
        cut = [max(0.1 * i, min(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i, 0.9 * i)) for i in (1, 2, 3)]
        total, freed = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            freed[g[:-1]] += cut[min(n, 3) - 1]
        return lambda g, lower: (counts[g] - cut[min(counts[g], 3) - 1]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * lower

    p3, p2, mass = level(three), level(two), sum(one.values()) + 128
    known = {g: math.log(p3(g, p2(g[1:], (one[g[2:]] + 1) / mass))) for g in three}
    for t in texts:
        own, words = grams(t.encode()), len(WORD.findall(t))
        yield sum(known[g] for g in own) / words if own and words else None


def test_kept_against_plain_python(spark, docs):
    rng = np.random.default_rng(11)
    vocabulary = {"ru": ["слово", "мир", "дом", "вода", "небо", "город", "река", "поле"], "zh": ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 12))) for _ in range(400)], None: ["alpha", "beta", "gamma", "delta", "omega"]}
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").orderBy("doc_id").limit(80).collect()]
    for lang, words in vocabulary.items():
        for i in range(8 if lang == "zh" else 25):
            # no 5-word window twice: a number that only this place has among every four words
            text = [f"{i * 40 + j}" if j % 4 == 3 else words[rng.integers(len(words))] for j in range(36)]
            rows.append((10_000 + len(rows), " ".join(text), lang))
        rows.append((20_000 + len(rows), " ".join("".join(rng.choice(list("#%&$|@^~QXZ0123456789"), 40)) for _ in range(36)), lang))
    stats = [_statistics(t) for _, t, _ in rows]
    failed = [n < 10 or 100 * repeat > 20 * n for n, _, _, _, repeat in stats]
    score = list(_kneser_ney([t or "" for _, t, _ in rows]))
    rank = lambda x, p: sorted(x)[max(math.ceil(p * len(x)), 1) - 1]
    close = set()

    def verdicts(band):
        for lang in {band(r[2]) for r in rows}:
            mine = [i for i, r in enumerate(rows) if band(r[2]) == lang]
            passed = [i for i in mine if not failed[i] and score[i] is not None]
            low, middle, high = (rank([score[i] for i in passed], p) for p in (0.25, 0.5, 0.75))
            noise = rank([abs(score[i] - middle) * math.sqrt(stats[i][0]) for i in passed], 0.5)
            for i in mine:
                room = math.sqrt((rules.BAND * (high - low)) ** 2 + (rules.ERRORS * noise) ** 2 / max(stats[i][0], 1))
                close.update([rows[i][0]] if score[i] is not None and abs(abs(score[i] - middle) - room) < 1e-3 else [])
                yield rows[i][0], not failed[i] and (score[i] is None or abs(score[i] - middle) <= room)

    want, pooled = dict(verdicts(lambda x: x)), dict(verdicts(lambda x: "*" if x in vocabulary else x))
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and len(close) < 5
    assert {k: v for k, v in got.items() if k not in close} == {k: v for k, v in want.items() if k not in close}
    # one band for all rarer languages rejects the smallest of them whole
    zh = [k for k, _, lang in rows if lang == "zh" and k < 20_000]
    assert not any(pooled[k] for k in zh) and all(got[k] for k in zh)


# -- 8 --------------------------------------------------------------------------------------------------------------------------


def test_mixing_follows_weights_and_seed(spark, odd):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(7).alias("stratum"))
    out = mixing.replicate(df, "doc_id", "source", F.lit(10), {"a": 0.6, "b": 0.1}, seed="s").cache()
    n = collections.Counter(r.source for r in out.select("source").collect())
    assert n["a"] == pytest.approx(18000, rel=0.03) and n["b"] == pytest.approx(3000, rel=0.06) and n[None] == pytest.approx(9000, rel=0.04)
    again = mixing.replicate(df.repartition(7), "doc_id", "source", F.lit(10), {"a": 0.6, "b": 0.1}, seed="s")
    pick = lambda d: {(r.doc_id, r.copy, r.n_copies) for r in d.select("doc_id", "copy", "n_copies").collect()}
    assert pick(out) == pick(again) and "stratum" in out.columns
    copies = collections.Counter(r.n_copies for r in out.filter("source = 'a' and copy = 0").collect())
    rate = 1.8
    for k in range(1, 5):
        assert copies[k] / 10000 == pytest.approx(math.exp(-rate) * rate**k / math.factorial(k), abs=0.02)
    assert mixing.replicate(empty(df), "doc_id", "source", F.lit(1), {"a": 0.5}).count() == 0
    assert set(mixing.replicate(odd, "doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))) + 1, {"a": 0.5}).columns) >= set(odd.columns)


def test_mixing_with_absent_and_scarce_sources(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "a").otherwise("other").alias("source"))
    absent = mixing.replicate(df.filter("source = 'other'"), "doc_id", "source", F.lit(10), {"a": 0.3, "b": 0.2})
    assert absent.count() == pytest.approx(19998, rel=0.03)
    rates = {r.stratum: r.rate for r in mixing.source_rates(df, "source", F.lit(10), {"a": 0.3, "b": 0.2}).collect()}
    assert rates == pytest.approx({"=a": 20000 * 0.375 / 2, "*": 20000 * 0.625 / 19998})
    n = collections.Counter(r.source for r in mixing.replicate(df, "doc_id", "source", F.lit(10), {"a": 0.3, "b": 0.2}).select("source").collect())
    assert n["a"] == pytest.approx(7500, abs=6 * math.sqrt(7500)) and n["other"] == pytest.approx(12500, rel=0.03)
    for rate in (100.0, 600.0, 2500.0):
        one = spark.createDataFrame([(rate,)], "rate double")
        first, last = int(rate - 12 * math.ceil(math.sqrt(rate))), int(rate + 12 * math.ceil(math.sqrt(rate)))
        got = one.select(mixing.large_poisson_cdf(F.col("rate"), F.lit(max(first, 0)), F.lit(last)).alias("c")).first().c
        total, want = 0.0, []
        for k in range(max(first, 0), last + 1):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            want.append(total)
        assert got == pytest.approx(want, abs=1e-9)


# -- 9 --------------------------------------------------------------------------------------------------------------------------


def test_masks_are_lossless():
    for gone in itertools.combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.FEWEST):
        assert any(all(m != "1" or at + i not in gone for i, m in enumerate(mask)) for mask in decontam.MASKS for at in range(decontam.WINDOW - len(mask) + 1))


def test_decontamination_tolerates_substitutions(spark, docs, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text.split() for r in benchmark.orderBy("item_id").limit(12).collect()]
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i, words in enumerate(items):
        for j, share in enumerate((0.0, 0.12, 0.6)):
            changed = [w if rng.random() >= share else f"zz{rng.integers(99)}" for w in words]
            rows.append((i * 10 + j, "before it " * 20 + " ".join(changed).upper() + " and after " * 20))
            equal = [a.upper() == b.upper() for a, b in zip(words, changed)]
            width = min(16, len(words))
            want[i * 10 + j] = max(sum(equal[k : k + width]) for k in range(len(words) - width + 1)) * 16 >= width * 13
    got = {r.doc_id: r.contaminated for r in decontam.mark(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    sure = {k: v for k, v in want.items() if v}
    assert all(got[k] for k in sure) and not any(got[k] for k in want if k % 10 == 2 and not want[k])
    tokens = lambda t: " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()))
    whole = [tokens(r.text) for r in benchmark.collect()]
    marked = {r.doc_id: r.contaminated for r in decontam.mark(docs, benchmark).collect()}
    assert all(marked[r.doc_id] for r in docs.collect() if any(f" {w} " in f" {tokens(r.text)} " for w in whole))
    items = spark.createDataFrame([(1, None), (1, ""), (None, "one two three four five six seven eight nine ten")], "item_id long, text string")
    out = collections.Counter((r.doc_id, r.contaminated) for r in decontam.mark(odd, items).collect())
    assert out[(1, True)] == 2 and out[(None, True)] == 1 and out[(3, False)] == 1 and sum(out.values()) == 10
    ten = "one two three four five six seven eight nine ten"
    ids = spark.createDataFrame([(None, ten), (4, ten), (4, ten + " eleven"), (None, "two three four five six"), (5, "no such words in any text")], "item_id long, text string")
    assert {(r.contaminated, r.n_items) for r in decontam.mark(odd, ids).filter("doc_id <= 2").collect()} == {(True, 2)}
    assert decontam.drop_contaminated(odd, items).count() == 6 and decontam.mark(empty(odd), items).count() == 0
    assert decontam.drop_contaminated(odd, empty(items)).columns == odd.columns


@pytest.mark.parametrize("width", range(1, 17))
def test_masks_are_lossless_at_every_width(width):
    if width <= decontam.SHORT:
        masks = [(m, 0) for m in decontam.short_masks(width)]
    else:
        masks = [([i for i, x in enumerate(mask) if x == "1"], at) for mask in decontam.MASKS for at in range(width - len(mask) + 1)]
    for gone in itertools.combinations(range(width), width - math.ceil(width * decontam.FEWEST / decontam.WINDOW)):
        assert any(all(at + i not in gone for i in mask) for mask, at in masks)


def test_short_and_unspaced_items_are_found(spark):
    items, rows, want = [], [], set()
    for n in range(1, 17):
        words = [f"q{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - math.ceil(n * 13 / 16)
        for gone in itertools.combinations(range(n), min(allowed + 1, 2)):
            text = "before it " + " ".join("zz" if i in gone else w for i, w in enumerate(words)) + " and after"
            rows.append((len(rows), text))
            if len(gone) <= allowed:
                want.add((len(rows) - 1, n))
        rows.append((len(rows), " ".join(words).upper()))
        want.add((len(rows) - 1, n))
    items += [(100, "敏捷的棕色狐狸跳过懒狗"), (101, "いろはにほへと"), (102, "東京")]
    for item, text in ((100, "从前敏捷的棕色狐狸跳过懒狗。"), (100, "看敏捷的棕色狐狼跳过懒狗abc"), (101, "それはいろはにほへとです"), (102, "私は東京にいる"), (None, "東の京"), (None, "敏捷狐狸")):
        rows.append((len(rows), text))
        want |= {(len(rows) - 1, item)} if item else set()
    found = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc, r.item) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


# -- 10 -------------------------------------------------------------------------------------------------------------------------


def _removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        yield len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def test_deep_shallow_sort_by_definition():
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 9, 500))
    key = rng.integers(0, 12, 500).astype(np.uint64) + np.uint64(1 << 63)
    order, number = suffixes._quicksort(group, key)
    pairs = list(zip(group[order], key[order]))
    assert pairs == sorted(zip(group, key)) and sorted(order) == list(range(500))
    assert [a == b for a, b in zip(number, number[1:])] == [a == b for a, b in zip(pairs, pairs[1:])]
    for size in (0, 1, 3, 400):
        data = rng.integers(97, 99, 3000).astype(np.uint8)
        data[1000:1600] = data[:600]
        start, bucket = rng.integers(0, 2600, size), rng.integers(0, 3, size)
        own = [(b, data[a : a + 200].tobytes()) for a, b in zip(start, bucket)]
        often = collections.Counter(own)
        assert suffixes.repeated_suffixes(data, start, bucket).tolist() == [often[x] > 1 for x in own]


def test_suffix_dedup_against_brute_force(spark, docs, odd, monkeypatch):
    rng = np.random.default_rng(9)
    shared = "".join(rng.choice(list("abcdefgh \n"), 900))
    more = [(20_000 + i, "".join(rng.choice(list("xyz é"), 80)) + shared[a : a + n] + "".join(rng.choice(list("xyz"), 60))) for i, (a, n) in enumerate(rng.integers([0, 150], [500, 400], (60, 2)))]
    more += [(30_000, "ab" * 400), (30_001, "ab" * 99 + "c"), (30_002, "x" * 199), (30_003, "y" * 200), (30_004, "z" * 201)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = df.collect()
    want = {r.doc_id: w for r, w in zip(rows, _removed([r.text for r in rows]))}
    # buckets split once or never, by ranges until they are small, and down to single distances and beyond
    for group, ranges in ((suffixes.GROUP, suffixes.RANGES), (6, suffixes.RANGES), (1, (50, 1))):
        monkeypatch.setattr(suffixes, "GROUP", group)
        monkeypatch.setattr(suffixes, "RANGES", ranges)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df).collect()}
        assert got == want
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter(zip([r.doc_id for r in rows], _removed([r.text for r in rows])))
    assert collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.digests(odd).collect()) == want
    assert suffixes.digests(empty(odd)).count() == 0


class _Captured:
    """Takes the place of a table: keeps the function that tasks would run."""

    def __getattr__(self, name):
        return lambda *args, **kwargs: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _peak_mb(operator, batches):
    """The most memory that numpy takes at once while a task maps the batches."""
    table = _Captured()
    operator(table)
    tracemalloc.start()
    for _ in table.run(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_memory_of_a_task_is_that_of_small_chunks(spark):
    """Two tasks, and workers that wait, share what an executor's heap leaves."""
    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(16)] * 2000), pa.array(["".join(rng.choice(list("abcdefgh  \n"), 2000)) for _ in range(2000)])], ["rid", "text"])
    assert _peak_mb(suffixes._anchors, [batch]) < 50
    assert _peak_mb(lambda t: rules.count_trigrams(t, F.lit("*")), [batch]) < 50
    n = 20_000
    ctx = rng.integers(97, 105, (n, 300)).astype(np.uint8)
    bucket = np.sort(rng.integers(0, n // 4, n))
    columns = [bucket, bucket, np.arange(n), np.ones(n, bool), np.zeros(n, bool), np.zeros(n, np.int32), np.full(n, 100, np.int32), [x.tobytes() for x in ctx]]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], suffixes._COLUMNS)
    assert _peak_mb(suffixes._sorted_spans, [rows.slice(0, n // 2), rows.slice(n // 2)]) < 100


def test_buckets_stay_whole(spark):
    for sizes in ([], [1], [5000], [1] * 5000, [3000, 1, 1, 4000, 2], [2047, 1, 1, 2047]):
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        parts = [t.column("bucket").to_pylist() for t in suffixes._whole_buckets(pa.table({"bucket": bucket.astype(np.int64)}))]
        assert list(itertools.chain.from_iterable(parts)) == bucket.tolist() and all(parts)
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:])) and all(len(p) <= suffixes.GROUP or len(set(p)) == 1 for p in parts)


# -- pipeline -------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    """Each stage against a plain version of its rule, on what the one before kept."""
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        assert after.columns == [*docs.columns, *(["shard"] if name == "sharding" else [])]
        rows, ids = before.collect(), sorted(r.doc_id for r in after.collect())
        if name == "quality_rules":
            assert ids == sorted(r.doc_id for r in rules.judge(before).filter("kept").collect())
            stats = {r.doc_id: _statistics(r.text) for r in rows}
            assert all(stats[i][0] >= 10 and 100 * stats[i][4] <= 20 * stats[i][0] for i in ids)
        if name == "ngram_jaccard":
            root = _components([r.doc_id for r in rows], list(_sets(r.text for r in rows)))
            assert ids == sorted(set(root.values()))
        if name == "benchmark_decontamination":
            items = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert ids == sorted(r.doc_id for r in rows if not any(_overlaps(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (r.text or "").lower()), i) for i in items))
        if name == "source_mixing":
            size = lambda r: len((r.text or "").encode()) + 1
            total = sum(map(size, rows))
            held = collections.Counter()
            for r in rows:
                held[r.source if r.source in queries.MIX else "*"] += size(r)
            share = queries.MIX | {"*": 1 - sum(queries.MIX.values())}
            there = sum(share[k] for k in held)
            want = collections.Counter()
            for r in rows:
                k = r.source if r.source in queries.MIX else "*"
                rate = total * share[k] / there / held[k]
                u = (int(hashlib.md5(f"mix/{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                n, p = 0, math.exp(-rate)
                c = p
                while c <= u:
                    n, p = n + 1, p * rate / (n + 1)
                    c += p
                want[r.doc_id] += n
            assert collections.Counter(ids) == +want
        if name == "sharding":
            draw = lambda i, k: -math.log((int(hashlib.md5(f"{i}/{k}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))
            assert all(r.shard == min(range(16), key=lambda k: draw(r.doc_id, k)) for r in after.collect()) and len(ids) == len(rows)
        assert ids
        before = after


def _overlaps(tokens, item):
    """Whether 16 aligned tokens, or all of a shorter item, agree in 13 of 16."""
    width = min(16, len(item))
    for diagonal in range(-len(item), len(tokens)):
        lo, hi = max(0, diagonal), min(len(tokens), diagonal + len(item))
        equal = [tokens[i] == item[i - diagonal] for i in range(lo, hi)]
        if len(equal) >= width and sum(equal) * 16 >= 13 * width and max(sum(equal[k : k + width]) for k in range(len(equal) - width + 1)) * 16 >= 13 * width:
            return True
    return False


def _largest_plan(spark, act):
    """Operators in the largest plan that Spark ran during ``act``."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        bus.waitUntilEmpty(60_000)
        listed = store.executionsList()
        each = [listed.apply(i) for i in range(listed.size())]
        return {e.executionId(): e.physicalPlanDescription() for e in each}

    before = plans()
    act()
    return max(len(re.findall(r"^\(\d+\) ", text, re.M)) for i, text in plans().items() if i not in before)


def test_driver_plans_stay_small(spark, docs):
    # the driver's memory goes up with each plan's size, not with the input's: one plan for the whole model had 404 operators, the first round of stars over these pairs 357
    assert _largest_plan(spark, lambda: rules.train(docs, F.lit("*"))) < 150
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).union(docs.select("doc_id", F.col("doc_id") + 2))
    assert _largest_plan(spark, lambda: components(pairs).count()) < 150


def test_pipeline_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows and clashing names pass every stage without harm, and so do no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert set(out.columns) >= set(odd.columns)
        n = collections.Counter(r.doc_id for r in out.collect())
        if name == "quality_rules":
            assert set(n) <= {1, 2, None} and stage(spark, odd, SF).filter("text is null").count() == 0
        if name == "benchmark_decontamination":
            assert n == collections.Counter(r.doc_id for r in odd.collect())
        if name == "ngram_jaccard":
            assert n == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2}
        if name == "sharding":
            assert sum(n.values()) == 10
        assert stage(spark, empty(odd), SF).count() == 0
    out = suffixes.remove_repeats(odd).collect()
    assert len(out) == 10 and all(r.kept == b"" for r in out if r.doc_id in (3, 4))


def test_jaccard_takes_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([("b", text), ("a", text + " x"), ("c", "other words here"), (None, text)], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in jaccard.linked(rows).collect()} == {"a": "a", "b": "a", "c": "c", None: "a"}


# -- 11: importance resampling -------------------------------------------------------------------------------------------------------


def _resampled(rows, target, share=25, seed=7):
    """The contract in plain Python: (doc_id, n_features, weight, score, rank)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

    def buckets(text):
        w = word.findall((text or "").translate(low))
        return len(w), [zlib.crc32(g.encode()) % 10000 for g in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    def counts(texts):
        return collections.Counter(b for x in texts for b in buckets(x)[1])

    s, t = counts(x for _, x in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out = []
    for doc, text in rows:
        n, b = buckets(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        out.append([doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: share * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_against_plain_python(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _resampled(rows, target)


@pytest.mark.parametrize("share", [0, 25, 100])
def test_resampling_on_odd_rows(spark, odd, share):
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(9, "alpha BETA gamma " * 9), (10, "alpha beta gamma " * 9), (10, "alpha beta gamma " * 9)]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("part", F.lit(1))
    got = importance.resample(more, target, share=share).collect()
    assert sorted((tuple(r) for r in got), key=str) == _resampled(rows, ["one two three", None, ""], share)
    assert importance.resample(empty(more), target).collect() == []
    assert len(importance.resample(more, empty(target)).collect()) == len(rows)
    by_name = importance.resample(more.withColumn("doc_id", F.col("doc_id").cast("string")), target, share=share).collect()
    assert sorted(r.score for r in by_name) == sorted(r.score for r in got)


def test_one_dictionary_serves_every_length(spark):
    text = pa.array(["The cat, the CAT sat", None, "", "x", "ünï cat sat the cat"])
    for longest in (1, 2, 3):
        (c,) = K.chunks(text)
        f = importance.features(c, 1 << 20, longest)
        want = []
        for row, words in enumerate([["the", "cat", "the", "cat", "sat"], [], [], ["x"], ["ünï", "cat", "sat", "the", "cat"]]):
            want += [(row, zlib.crc32(" ".join(words[i : i + n]).encode()) % (1 << 20)) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        assert sorted(zip(f.row.tolist(), f.bucket.tolist(), strict=True)) == sorted(want)
        assert f.n_words.tolist() == [5, 0, 0, 1, 5]


# -- 12: conversation repair ---------------------------------------------------------------------------------------------------------


def _best_edits(initials, faults):
    """The cheapest edits by trying every role sequence that is allowed: (cost, audit)."""
    best = None
    n = len(initials)
    for head, pairs in [("", k) for k in range(n + 2)] + [("s", k) for k in range(1, n + 2)]:
        goal = head + "ua" * pairs
        ways = {(0, 0): (0, "")}  # turns used and letters made: the best so far
        for i in range(n + 1):
            for j in range(len(goal) + 1):
                if (i, j) not in ways:
                    continue
                cost, audit = ways[i, j]
                nexts = []
                if j < len(goal) and goal[j] in "ua":
                    nexts.append((i, j + 1, 3, "I"))
                if i < n:
                    nexts.append((i + 1, j, 4, "D"))
                    if j < len(goal) and faults[i] not in ("blank", "duplicate"):
                        extra = 3 * (faults[i] == "truncated")
                        if initials[i] == goal[j]:
                            nexts.append((i + 1, j + 1, extra, "K"))
                        if goal[j] in "ua":
                            nexts.append((i + 1, j + 1, 3 + extra, "R"))
                for a, b, price, letter in nexts:
                    way = (cost + price, audit + letter)
                    if (a, b) not in ways or way < ways[a, b]:
                        ways[a, b] = way
        if (n, len(goal)) in ways and (best is None or ways[n, len(goal)] < best):
            best = ways[n, len(goal)]
    return best


def test_repair_against_every_role_sequence(spark):
    random = np.random.default_rng(3)
    texts = ["Fine.", "Fine.", "Good?", "cut off", " \n", "", "So!  ", "x"]
    rows = [(c, t, str(random.choice(["system", "user", "assistant", "tool", "user", "assistant"])), str(random.choice(texts))) for c in range(60) for t in range(int(random.integers(0, 8)))]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(x[1:] for x in rows if x[0] == conv)
        faults, seen = [], set()
        for _, role, text in turns:
            solid = text.strip(" \n")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
            seen.add((role, text))
        assert (r.cost, r.audit) == _best_edits([role[0] for _, role, _ in turns], faults), turns
        roles = [x.split(":")[0][0] for x in r.repaired]
        assert re.fullmatch("(s?(ua)+)?", "".join(roles)) and len(roles) == len(r.audit) - r.audit.count("D")
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))


def test_repair_by_hand_and_odd(spark):
    schema = "conv_id long, turn long, role string, text string, fault int, cost string"
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."),
        (2, 5, "assistant", "Ho."), (2, None, "user", "Hi."), (2, 9, None, None),
        (None, 1, "user", "a."), (None, 1, "user", "a."), (None, 3, "Assistant", "b"),
        (3, 0, "system", "S."), (4, None, None, None), (5, 0, "user", "w " * 5000 + "."),
    ]
    df = spark.createDataFrame([(*r, i, "q") for i, r in enumerate(rows)], schema)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired) for r in repair.repair(df).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", ["user:Hi.", "assistant:Ho."])
    assert got[2] == (3, 1, 0, 0, 1, 4, "KKD", ["user:Hi.", "assistant:Ho."])
    assert got[None][:7] == (1, 0, 1, 1, 2, 10, "KDR") and got[None][7] == ["user:a.", "assistant:b"]
    assert got[3] == (0, 0, 0, 0, 0, 4, "D", []) and got[4] == (0, 1, 0, 0, 0, 4, "D", [])
    assert got[5][5:7] == (3, "KI")
    assert repair.repair(empty(df)).collect() == [] and repair.report(empty(df), empty(df)).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", nothing) for r in repair.report(df, empty(df)).collect())
    assert repair.report(df, empty(df)).count() == 6


# -- 13: nearest neighbours ----------------------------------------------------------------------------------------------------------


def _brute(rows, k):
    """(query_id, rank) -> (vec_id, score) of all rows whose id is divisible by 20."""
    out = {}
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), n) for j, (n, x) in enumerate(rows) if j != i and len(x) == len(v))[:k]
            out |= {(q, r + 1): (n, -s) for r, (s, n) in enumerate(best)}
    return out


def test_neighbours_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = _brute(rows, 20)
    got = neighbours.nearest(df.repartition(3), F.col("vec_id") % 20 == 0, block=128, group=8).collect()
    assert len(got) == len(want) == len({(r.query_id, r["rank"]) for r in got})
    found, hoped = collections.defaultdict(set), collections.defaultdict(set)
    exact = dict(rows)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(sum(a * b for a, b in zip(exact[r.query_id], exact[r.vec_id], strict=True)), abs=1e-12) and r.vec_id != r.query_id
    for (q, _), (n, _) in want.items():
        hoped[q].add(n)
    assert sum(len(found[q] & hoped[q]) for q in hoped) >= 0.95 * len(want)


def test_neighbours_of_skewed_norms_ties_and_copies(spark):
    random = np.random.default_rng(5)
    rows = [(i, (random.standard_normal(8) * 10.0 ** float(random.uniform(-2, 2))).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(150)] + [(1000 + i, [0.5, -0.5]) for i in range(41)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, block=64, group=4).collect()
    want = _brute(rows, 5)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got if r.query_id >= 300} == {k: v[0] for k, v in want.items() if k[0] >= 300}
    hit = sum(want[r.query_id, r["rank"]][0] == r.vec_id for r in got)
    assert len(got) == len(want) and hit >= 0.9 * len(want)


def test_neighbours_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (140, [3.0]), (7, [-0.0, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, block int, key string")
    ask = F.col("vec_id") % 20 == 0
    got = sorted(tuple(r) for r in neighbours.nearest(df, ask).collect())
    assert got == sorted([(0, 1, 0, 5.0), (0, 2, 7, 2.0), (0, 3, 9, 2.0)] * 2)
    assert neighbours.nearest(empty(df), ask).collect() == []
    assert neighbours.nearest(df, F.col("vec_id") == 5).collect() == []


def test_collisions_need_not_be_complete():
    """A vector at the windows' radius is verified with a chance of 0.95, and windows that hold everything miss nothing."""
    random = np.random.default_rng(9)
    near = sum(np.sum(np.abs(random.standard_normal(neighbours.PROJECTIONS)) <= neighbours.HALF_WIDTH) >= neighbours.threshold() for _ in range(2000)) / 2000
    assert near >= 0.93
    vectors = random.standard_normal((50, 6))
    for found, product in neighbours.search(neighbours.build(vectors), vectors[:3], 100):
        assert sorted(found.tolist()) == list(range(50)) and len(product) == 50


def test_scopes_of_two_threads_stay_apart(spark):
    """A block that ends in one thread removes nothing that another still reads."""
    ready, done, seen = threading.Event(), threading.Event(), {}

    def other():
        with storage.temporary(spark):
            table = storage.materialize(spark.range(5), "other")
            ready.set()
            done.wait(60)
            seen["rows"] = table.count()

    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    with storage.temporary(spark):
        mine = storage.materialize(spark.range(3), "mine")
        kept = storage.materialize(spark.range(4), "kept", keep=True)
        assert mine.count() == 3
    done.set()
    thread.join()
    assert seen == {"rows": 5} and kept.count() == 4
    with pytest.raises(Exception, match="mine-"):
        mine.count()
