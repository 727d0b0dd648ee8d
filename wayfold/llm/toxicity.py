"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words sums over all subsequences of three letters that both have, gaps allowed, each weighted by DECAY to
the power of the two spans: an insult with a letter put in, left out or doubled keeps most of its subsequences. Words are compared
with a set of landmark words; the Nystroem map turns these kernel values into vectors, and a support vector machine learns on
sentences of labelled texts, of which the most suspicious word counts. A text's score comes from its most toxic words.

As the decision is a weighted sum of kernels with landmarks, and each kernel is a sum over subsequences, a
trained model comes down to one weight for each subsequence: scoring a word means adding up those of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm import folds
from wayfold.llm import kernels as K

ORDER, DECAY = 3, 0.6
#: Letters of a word that are compared at a time; longer words are read in windows of so many, half a window apart.
WIDTH = 16
#: Labelled texts that are learned from, landmarks of either kind, other words, and rounds of choosing sentences' words.
SAMPLE, LANDMARKS, NEGATIVES, ROUNDS = 6000, 192, 24_000, 4
#: What the examples of a class may weigh against the margin.
COST = 3000.0
#: A text is judged by its so many most toxic words.
TOP = 2

#: Fixed letter classes: 1-26 a to z; digits read as the letters they stand for; other letters 27-42 by their last byte; 0 is dropped.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
for _digit, _as in zip("01345789", "oieastbg", strict=True):
    _LETTER[ord(_digit)] = ord(_as) - 96
_LETTER[128:192] = 27 + (np.arange(64) & 15)
CLASSES = 44
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_combos: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of all subsequences of a word of ``length`` letters, and their weights; the weights have length one."""
    if length not in _combos:
        at = np.array(list(itertools.combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
        weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
        _combos[length] = at, (weight / max(np.linalg.norm(weight), 1e-12)).astype(np.float32)
    return _combos[length]


def codes(words: np.ndarray) -> np.ndarray:
    """Subsequence codes of words of one length, a row of letter classes each."""
    at, _ = subsequences(words.shape[1])
    x = words.astype(np.int32)
    return (x[:, at[:, 0]] * CLASSES + x[:, at[:, 1]]) * CLASSES + x[:, at[:, 2]]


class Letters(NamedTuple):
    letters: np.ndarray  #: letter classes, word after word
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def spell(c: K.Chunk) -> Letters:
    """A chunk's words as letter classes, without what isn't a letter or digit. Three or more single letters in a row are one word more."""
    letter = _LETTER[c.data]
    kept = np.concatenate([[0], np.cumsum(letter > 0)])
    alpha = np.concatenate([[0], np.cumsum(_IS_LETTER[c.data])])
    w = K.words(c)
    start, end, doc = kept[w.start], kept[w.end], w.doc
    real = (end > start) & (alpha[w.end] > alpha[w.start])
    start, end, doc = start[real], end[real], doc[real]
    # words that are spelled out: neighbours of one letter each, next to each other among the kept letters
    one = end - start == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = one[1:] & one[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == end[:-1])
    first = np.flatnonzero(one & ~joined)
    last = np.flatnonzero(one & ~np.append(joined[1:], False))
    long = last - first >= 2
    return Letters(letter[letter > 0], np.append(start, start[first[long]]), np.append(end, end[last[long]]), np.append(doc, doc[first[long]]))


def pieces(s: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, word) of every window of every word of ORDER letters or more."""
    length = s.end - s.start
    use = np.flatnonzero(length >= ORDER)
    n = np.maximum(0, -(-(length[use] - WIDTH) // (WIDTH // 2))) + 1
    word = np.repeat(use, n)
    nth = np.arange(len(word)) - np.repeat(K.starts(n)[:-1], n)
    start = s.start[word] + nth * (WIDTH // 2)
    return start, np.minimum(s.end[word] - start, WIDTH), word


def _grouped(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows by length, in slices of bounded size: their numbers and their letters."""
    for size in np.unique(length):
        some = np.flatnonzero(length == size)
        step = max(1, (1 << 20) // len(subsequences(int(size))[1]))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            yield part, letters[start[part][:, None] + np.arange(size)]


class Model(NamedTuple):
    weights: np.ndarray  #: of each subsequence
    bias: float
    logistic: np.ndarray  #: of a text's TOP margins, largest first, and the constant


def margins(letters: np.ndarray, start: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.float32)
    for part, words in _grouped(letters, start, length):
        out[part] = weights[codes(words)] @ subsequences(words.shape[1])[1]
    return out


def _distinct(s: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, each different one once: (start, length, which one each window is, each window's document)."""
    start, length, word = pieces(s)
    h = K.range_hash(K.prefix_hash(s.letters), start, start + length)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return start[first], length[first], which, s.doc[word]


def text_margins(c: K.Chunk, model: Model) -> np.ndarray:
    """The TOP largest margins of words of each row, largest first; -1 where there are fewer words."""
    s = spell(c)
    out = np.full((c.rows, TOP), -1.0, np.float32)
    if len(s.start):
        start, length, which, doc = _distinct(s)
        margin = np.maximum(margins(s.letters, start, length, model.weights) + model.bias, -1)[which]
        order = np.lexsort((-margin, doc))
        doc, margin = doc[order], margin[order]
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = nth < TOP
        out[doc[top], nth[top]] = margin[top]
    return out


def probability(top: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(top.astype(float) @ model.logistic[:-1] + model.logistic[-1], -50, 50)))


# -- training on the driver, from a bounded sample -------------------------------------------------------------------------------


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps on the primal; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a, b = x[inside], y[inside]
        weighted = a * cost[inside][:, None]
        step = np.linalg.solve(ridge + weighted.T @ a, weighted.T @ b)
        if np.allclose(step, w, atol=1e-5):
            break
        w = step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of x and a constant for P(y = 1), lightly held back so that separable samples stay finite."""
    a = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (p - y) + 0.05 * w)
        w = w - step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-9))
    return w


def _mutated(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Each word twice with a letter put in, and with one doubled: what writers do to get past word lists."""
    out = []
    for w in words:
        at, other = (int(x) for x in rng.integers(1, len(w), 2))
        letter, second = (bytes([int(x)]) for x in rng.integers(1, 27, 2))
        out += [w[:at] + letter + w[at:], w[:other] + second + w[other:], w[:at] + w[at - 1 : at] + w[at:]]
    return [w[:WIDTH] for w in out]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc: str = "doc_id", text: str = "text", most: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learns from at most ``most`` of the documents that ``labels`` (doc_id, label 0 or 1) names, on the driver.

    Sentences end at ., !, ? or a new line. Landmarks are the words most typical of toxic texts and words drawn from the others. In
    each round a toxic text's sentences are represented by their most suspicious word and those whose word
    is suspicious enough are the positive examples; the other texts' words are the negative ones. Without either
    kind of text, or a word that two toxic texts share, the score is 0 everywhere.
    """
    got = folds.labelled_sample(docs, labels, label, most, doc=doc, text=text).toArrow()
    texts, y = got.column(0).to_pylist(), got.column(1).to_numpy().astype(int)
    size = CLASSES**ORDER
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), -1.0, np.array([0.0] * TOP + [-50.0]))
    sentences: list[tuple[int, int, list[bytes]]] = []  # text, label, words
    seen = [{}, {}]  # how many texts of either label have a word
    for i, t in enumerate(texts):
        parts = t.replace("!", ".").replace("?", ".").replace("\n", ".\n").split(". ") if t else []
        s = spell(c := next(K.chunks(pa.array(parts), 1 << 40))) if parts else None
        if s is None:
            continue
        start, length, word = pieces(s)
        raw = s.letters.tobytes()
        own: list[list[bytes]] = [[] for _ in range(c.rows)]
        for a, n, d in zip(start.tolist(), length.tolist(), s.doc[word].tolist()):
            own[d].append(raw[a : a + n])
        for w in {x for ws in own for x in ws}:
            seen[y[i]][w] = seen[y[i]].get(w, 0) + 1
        sentences += [(i, y[i], ws) for ws in own if ws]
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    lift = {w: k / n1 * np.log(k / n1 / ((seen[0].get(w, 0) + 1) / (n0 + n1))) for w, k in seen[1].items() if k > 1}
    typical = sorted(lift, key=lambda w: (-lift[w], w))[: landmarks * 2 // 3]
    if not typical or not seen[0]:
        return Model(np.zeros(size, np.float32), -1.0, np.array([0.0] * TOP + [-50.0]))
    by_count = sorted(seen[0], key=lambda w: (-seen[0][w], w))
    rng = np.random.default_rng(11)
    rare = by_count[2000:]
    drawn = [rare[i] for i in rng.permutation(len(rare))[: max(0, NEGATIVES - 2000)]]
    negatives = by_count[:2000] + drawn
    others = [negatives[i] for i in rng.permutation(len(negatives))[: landmarks - len(typical)]]
    marks = list(dict.fromkeys(typical + others))

    def features_of(words: list[bytes], table: np.ndarray) -> np.ndarray:
        flat = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        start = K.starts(length)[:-1]
        out = np.zeros((len(words), table.shape[1]), np.float32)
        for part, letters in _grouped(flat, start, length):
            code, weight = codes(letters), subsequences(letters.shape[1])[1]
            for j in range(code.shape[1]):
                out[part] += table[code[:, j]] * weight[j]
        return out

    table = np.zeros((size, len(marks)), np.float32)
    for i, w in enumerate(marks):
        np.add.at(table[:, i], codes(np.frombuffer(w, np.uint8)[None])[0], subsequences(len(w))[1])
    gram = features_of(marks, table).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3 * values.max()
    nystroem = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    with_bias = lambda words: np.hstack([features_of(words, table) @ nystroem, np.ones((len(words), 1), np.float32)])
    negative = with_bias(negatives)
    clean = by_count
    suspicious = [max(ws, key=lambda w: (lift.get(w, -1), w)) for _, t, ws in sentences if t]
    limit = lift[typical[-1]]
    rare_elsewhere = lambda w: seen[0].get(w, 0) / n0 < 0.1 * seen[1].get(w, 0) / n1
    sure = {w for w in suspicious if lift.get(w, -1) >= max(limit, 1e-3) and rare_elsewhere(w)}
    chosen = sorted(sure) or typical[:1]
    toxic = list({w for _, t, ws in sentences if t for w in ws})
    beta, bias = np.zeros(size, np.float32), -1.0
    for _ in range(ROUNDS):
        words = sorted(set(chosen))
        positive = with_bias(words + _mutated(words, rng))
        often = np.sqrt([seen[1].get(w, 1) for w in words])
        often = np.concatenate([often, np.repeat(often, 3) / 2])
        x = np.vstack([positive, negative])
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        cost = np.concatenate([often / often.sum(), np.full(len(negative), 3.0 / len(negative))]) * COST
        w = _squared_hinge(x.astype(float), sign, cost)
        beta, bias = (table @ (nystroem @ w[:-1].astype(np.float32))).astype(np.float32), float(w[-1])
        # clean words that look worst join the negative examples
        looks = features_of(clean, beta[:, None])[:, 0]
        negative = np.vstack([negative, with_bias([clean[i] for i in np.argsort(-looks, kind="stable")[: NEGATIVES // 8]])])
        score = dict(zip(toxic, (features_of(toxic, beta[:, None])[:, 0] + bias).tolist()))
        best = [max(ws, key=lambda v: (score[v], v)) for _, t, ws in sentences if t]
        chosen = [*sure, *(v for v in best if score[v] > 0 and rare_elsewhere(v))]
    model = Model(beta, bias, np.zeros(TOP + 1))
    top = np.concatenate([text_margins(c, model) for c in K.chunks(pa.array(texts))])
    return model._replace(logistic=_logistic(top, y))


def score(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability, by its most toxic words, that the text is toxic.

    Whole texts are read. Texts without a word (null, empty) get the score of no suspicion at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                p = probability(text_margins(c, m), m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(p)], ["doc", "score"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(run, f"doc {kind}, score double").withColumnRenamed("doc", doc)
