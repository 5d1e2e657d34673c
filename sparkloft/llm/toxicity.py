"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and spans."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.llm.common import small_batches

TRAIN_DOCS = 4000  # most labelled documents that the model is fitted on
TRAIN_BYTES = 8192  # a labelled text longer than this is no training example
TRAIN_CHAINS = 4000  # most chains the field is fitted on
FEATURES = 4000  # most word features that are kept
CHAIN = 48  # words in a chain; a longer text is a row of chains
THRESHOLD = 0.7
HELD_OUT, FOLDS = 1, 3
CACHE = 150_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; a character that lower-casing makes two of does not part its word."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def features(word: str) -> list[str]:
    """The word itself and its beginnings: word forms that share a stem share evidence."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(len(word), 8)))]


@dataclass
class Model:
    """Log-odds of a toxic tag by word feature, the chain's transitions, and the calibration of a document."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray  # [from, to], tags: 0 clean, 1 toxic
    start: np.ndarray
    calibration: np.ndarray  # of 1, log1p(expected toxic words), largest marginal, share

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray, full: bool = False):
    """Forward-backward over many chains side by side. emit: [chain, step] log-odds of the toxic tag, padded on the right.

    Returns P(toxic) by chain and step, and with ``full`` also the expected transitions, [chain count] log likelihood
    normaliser sum and the marginals of the first tags.
    """
    n, steps = emit.shape
    inside = np.arange(steps)[None] < length[:, None]
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 2)
    a = np.exp(trans)
    alpha, beta, logz = np.empty((n, steps, 2)), np.ones((n, steps, 2)), np.zeros(n)
    cur = np.exp(start)[None] * e[:, 0]
    for t in range(steps):
        if t:
            cur = np.where(inside[:, t, None], (alpha[:, t - 1] @ a) * e[:, t], alpha[:, t - 1])
        s = cur.sum(1, keepdims=True)
        logz += np.log(s[:, 0])
        alpha[:, t] = cur / s
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = np.where(inside[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    post = np.where(inside, p[:, :, 1], 0.0)
    if not full:
        return post
    expected = np.zeros((2, 2))
    for t in range(steps - 1):
        x = alpha[:, t, :, None] * a[None] * (e[:, t + 1] * beta[:, t + 1])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        expected += x[inside[:, t + 1]].sum(0)
    return post, expected, logz.sum(), p[:, 0].sum(0)


def _grid(values: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the word row of each document (ending at ``ends``) into chains: padded values, lengths and each chain's document."""
    starts = [0, *ends[:-1]]
    cuts, docs = [], []
    for d, (s, e) in enumerate(zip(starts, ends, strict=True)):
        for k in range(s, e, CHAIN):
            cuts.append((k, min(k + CHAIN, e)))
            docs.append(d)
    at = np.array(cuts, np.int64).reshape(-1, 2)
    length = at[:, 1] - at[:, 0]
    take = np.minimum(at[:, :1] + np.arange(CHAIN)[None], max(len(values) - 1, 0))
    return (values[take] if len(values) else np.zeros((0, CHAIN))), length, np.array(docs, np.int64)


def _document_features(post: np.ndarray, docs: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    n = len(n_words)
    total, top = np.zeros(n), np.zeros(n)
    if len(docs):
        np.add.at(total, docs, post.sum(1))
        np.maximum.at(top, docs, post.max(1))
    return np.stack([np.ones(n), np.log1p(total), top, total / np.maximum(n_words, 1)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fits the field and the document calibration.

    A document label is no word label, so the words of a toxic document are labelled toxic when one of their
    features is found among toxic documents more often than chance gives any of all features (a Chernoff bound), and
    in at least four toxic documents for each clean one; everything else is labelled clean. The field then learns
    weights of the features and the transitions from those tags by gradient ascent.
    With no toxic or no clean example every word scores clean and documents take the base rate.
    """
    words, kept, seen_runs = [], [], set()
    for t, mark in zip(texts, toxic, strict=True):  # a copy of an earlier example is no further evidence
        w = words_of(t)
        runs = {hash(x) for x in zip(w, w[1:], w[2:], strict=False)}
        if not runs or len(runs & seen_runs) <= 0.3 * len(runs):
            words.append(w)
            kept.append(mark)
        seen_runs |= runs
    toxic = kept
    y = np.array(toxic, float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return Model({}, -8.0, np.zeros((2, 2)), np.zeros(2), np.array([base, 0.0, 0.0, 0.0]))
    df = (Counter(), Counter())
    of_word: dict[str, list[str]] = {x: features(x) for w in words for x in w}
    for w, t in zip(words, toxic, strict=True):
        df[t].update({f for x in set(w) for f in of_word[x]})
    strength, lifted = {}, n1 / (n0 + n1)
    for f, a in df[1].items():
        b = df[0][f]
        q = a / (a + b)
        if a >= 3 and q > lifted:  # Chernoff bound on as many toxic documents among those with the feature
            strength[f] = (a + b) * (q * math.log(q / lifted) + (1 - q) * math.log(max(1 - q, 1e-12) / (1 - lifted)))
    chance = math.log(max(len(strength), 1))  # only features of three toxic examples can pass, so only they are tries
    chosen = sorted((f for f in strength if strength[f] >= chance / 2), key=lambda f: (-strength[f], f))[:FEATURES]
    marks = {f for f in chosen if strength[f] >= chance and df[1][f] >= 4 * df[0][f]}
    index = {f: i for i, f in enumerate(chosen)}
    known: dict[str, tuple[list[int], int]] = {}

    def of(word: str):
        if (x := known.get(word)) is None:
            fs = of_word[word]
            x = known[word] = ([index[f] for f in fs if f in index], int(any(f in marks for f in fs)))
        return x

    chains = []
    for w, t in zip(words, toxic, strict=True):
        for k in range(0, len(w), CHAIN):
            part = [of(x) for x in w[k : k + CHAIN]]
            chains.append((part, [m & t for _, m in part]))
    with_tag = [c for c in chains if any(c[1])]
    rest = [c for c in chains if not any(c[1])]
    step = max(1, math.ceil((len(with_tag) + len(rest)) / TRAIN_CHAINS))
    chains = [*with_tag[:: max(1, math.ceil(len(with_tag) / (TRAIN_CHAINS // 2)))], *rest[::step]]
    n, k = len(chains), len(index)
    length = np.array([len(c[0]) for c in chains])
    tags = np.zeros((n, CHAIN), np.int64)
    rows, cols = [], []
    for i, (part, tag) in enumerate(chains):
        tags[i, : len(tag)] = tag
        for j, (fs, _) in enumerate(part):
            rows += [i * CHAIN + j] * len(fs)
            cols += fs
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    inside = np.arange(CHAIN)[None] < length[:, None]
    gold = np.bincount(cols, weights=tags.ravel()[rows], minlength=k)
    gold_trans = np.zeros((2, 2))
    pair = inside[:, 1:]
    np.add.at(gold_trans, (tags[:, :-1][pair], tags[:, 1:][pair]), 1)
    gold_start = np.bincount(tags[:, 0], minlength=2).astype(float)
    seen = np.bincount(cols, minlength=k) + 1.0
    w, bias, trans, start = np.zeros(k), -4.0, np.zeros((2, 2)), np.zeros(2)
    rate, grad_w, grad_o = 0.6, np.zeros(k), np.zeros(7)
    total = inside.sum()
    for _ in range(25):  # ascent scaled by how often each feature is seen, with momentum
        emit = bias + np.bincount(rows, weights=w[cols], minlength=n * CHAIN)
        post, expected, _, first = marginals(emit.reshape(n, CHAIN), length, trans, start, full=True)
        flat = post.ravel()
        grad_w = 0.6 * grad_w + (gold - np.bincount(cols, weights=flat[rows], minlength=k) - 0.01 * w) / np.sqrt(seen) / 4
        other = np.concatenate(
            [
                [(tags.sum() - flat.sum()) / math.sqrt(total)], ((gold_trans - expected) / math.sqrt(total)).ravel(),
                (gold_start - first) / math.sqrt(n)
            ]
        ) / 8
        grad_o = 0.6 * grad_o + other
        w = np.clip(w + rate * np.clip(grad_w, -2, 2), -12, 12)
        move = np.clip(rate * grad_o, -0.5, 0.5)
        bias = max(bias + move[0], -12.0)
        trans = trans + move[1:5].reshape(2, 2)
        start = start + move[5:]
    model = Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(bias), trans, start, np.zeros(4))
    x = []
    for k0 in range(0, len(words), 500):
        x.append(_evidence(model, words[k0 : k0 + 500], {})[0])
    model.calibration = _logistic(np.concatenate(x), y)
    return model


def _evidence(model: Model, words: list[list[str]], cache: dict[str, float]):
    values, ends = [], []
    for w in words:
        for x in w:
            v = cache.get(x)
            if v is None:
                v = cache[x] = model.emission(x)
            values.append(v)
        ends.append(len(values))
    emit, length, docs = _grid(np.array(values), ends)
    inside = np.arange(CHAIN)[None] < length[:, None]
    plain = ((emit == model.bias) | ~inside).all(1)  # chains without any evidence: the marginals follow from the length
    post = np.zeros((len(emit), CHAIN))
    if plain.any():
        sizes = np.arange(1, CHAIN + 1)
        post[plain] = marginals(np.full((CHAIN, CHAIN), model.bias), sizes, model.trans, model.start)[length[plain] - 1]
    rest = np.flatnonzero(~plain)
    for k in range(0, len(rest), 4096):
        part = rest[k : k + 4096]
        post[part] = marginals(emit[part], length[part], model.trans, model.start)
    if len(cache) > CACHE:
        cache.clear()
    return _document_features(post, docs, np.diff([0, *ends])), post, docs


def score_texts(model: Model, texts: list[str | None], cache: dict[str, float], spans: bool = False):
    """Scores of whole texts (null: empty); with ``spans`` also each text's toxic words as (start, end, marginal)."""
    scores, found = np.zeros(len(texts)), [[] for _ in texts]
    at = 0
    while at < len(texts):  # groups of about 100,000 words bound the memory
        words, n, to = [], 0, at
        while to < len(texts) and (to == at or n < 100_000):
            words.append(words_of(texts[to] or ""))
            n += len(words[-1])
            to += 1
        x, post, docs = _evidence(model, words, cache)
        scores[at:to] = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
        if spans:
            hit: dict[int, dict[int, float]] = {}
            first = np.searchsorted(docs, np.arange(to - at))
            for c, j in zip(*np.nonzero(post > 0.5), strict=True):
                hit.setdefault(int(docs[c]), {})[int(c - first[docs[c]]) * CHAIN + int(j)] = float(post[c, j])
            for d, places in hit.items():
                found[at + d] = [(m.start(), m.end(), places[i]) for i, m in enumerate(_WORD.finditer(texts[at + d])) if i in places]
        at = to
    return (scores, found) if spans else scores


def train(docs: DataFrame, labels: DataFrame, use_fold=lambda i: i != HELD_OUT) -> Model:
    """Fits a model on at most TRAIN_DOCS labelled rows of the training folds, chosen by a hash of their ids.

    docs: (doc_id, text, ...); labels: (doc_id, toxic, ...). Rows with a null id, label or text are no examples.
    An empty sample gives a model with even odds.
    """
    in_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    keep = F.lit(False)
    for i in range(FOLDS):
        if use_fold(i):
            keep = keep | (in_fold == i)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)  # bounded, so it can be broadcast
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; spans: array of (start, end, marginal) code point offsets.

    Null and empty texts get the calibrated score of no evidence. held_out is null for a null doc_id.
    Only the text enters a score; repeated rows get equal scores; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        cache: dict[str, float] = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            scores, found = score_texts(sent.value, b.column(1).to_pylist(), cache, spans=True)
            held = pa.array([None if i is None else fold(i) == HELD_OUT for i in ids], pa.bool_())
            spans = pa.array([[{"start": s, "end": e, "marginal": p} for s, e, p in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), held, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), spans],
                names=["doc_id", "held_out", "score", "predicted", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay as they are."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        cache: dict[str, float] = {}
        for b in batches:
            yield b.filter(pa.array(score_texts(sent.value, b.column(at).to_pylist(), cache) < threshold))

    return docs.mapInArrow(run, docs.schema)
