"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed rows for the word, three prefixes and
one suffix. Filters of widths 1, 2 and 3 slide over the words of a text, each
filter is max-pooled over the whole text, and a logistic layer reads the pools.
Decision thresholds are calibrated for each language; the language is guessed
from the text by ``langid``, so neither labels nor the lang, source and doc_id
columns are inputs of a score. A score of 0.5 is the threshold.

The classifier is fitted on a bounded sample of labelled rows of any length: about
``SAMPLE`` documents of labels 0 and 1 (never over twice that), equal texts once.
Of a text over ``FIT_CHARS`` characters a window of so many is learned, at a place
that a hash of its id draws. Scoring reads whole texts of any length.

Edge cases: null and empty texts get the score of a text without words.
Without training rows of both classes every score is 0. Several label rows of
a document count as their largest label; null labels are ignored. Repeated
documents get equal scores, ties count as toxic (a score of 0.5), and an empty
table gives an empty result. ``harmless`` keeps the caller's columns, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm import langid
from agreemill.llm.common import col, fold, free_name, small_batches

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 15
FEATURES = 5
SAMPLE = (4500, 2500)
FIT_CHARS = 40_000
EPOCHS = 8
LANGUAGE_SAMPLE = 1500
BATCH = 128
CACHE_WORDS = 200_000
CHUNK_WORDS = 50_000

_words = re.compile(r"\w+").findall


def features(word: str) -> list[int]:
    h = xxhash.xxh32_intdigest
    parts = (f"w{word}", f"a{word[:3]}", f"b{word[:4]}", f"c{word[:5]}", f"z{word[-4:]}")
    return [h(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


@dataclass
class Model:
    """Trained weights: a few MB whatever the corpus size."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]
    threshold: float
    language: langid.Model
    trained: bool

    def pools(self, words: list[str], cache: _Responses) -> np.ndarray:
        """Max of each filter over all words, in chunks that overlap by 2."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, max(1, len(words)), CHUNK_WORDS):
            rows = cache.rows(words[at : at + CHUNK_WORDS + 2])
            n = min(CHUNK_WORDS, max(1, len(words) - at))
            rows = np.concatenate([rows, np.zeros((max(0, n + 2 - len(rows)), rows.shape[1]), np.float32)])
            first = 0
            for k, width in enumerate(WIDTHS):
                total = rows[:n, first : first + FILTERS]
                for j in range(1, width):
                    total = total + rows[j : n + j, first + j * FILTERS : first + (j + 1) * FILTERS]
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                best[part] = np.maximum(best[part], total.max(axis=0))
                first += width * FILTERS
        return np.maximum(best + self.bias, 0)

    def logits(self, texts: list[str | None], cache: _Responses) -> np.ndarray:
        pooled = np.stack([self.pools(_words((t or "").lower()), cache) for t in texts])
        return pooled @ self.out + self.out_bias

    def scores(self, texts: list[str | None], cache: _Responses) -> np.ndarray:
        if not texts or not self.trained:
            return np.zeros(len(texts))
        spoken = [x[0] for x in self.language.predict(texts)]
        shift = np.array([self.thresholds.get(x, self.threshold) for x in spoken])
        return 1 / (1 + np.exp(-np.clip(self.logits(texts, cache) - shift, -30, 30)))


class _Responses:
    """Filter responses of known words; forgotten when there are too many."""

    def __init__(self, model: Model):
        self.table = np.concatenate([w[j] for w in model.filters for j in range(len(w))], axis=1)
        self.embedding = model.embedding
        self.index: dict[str, int] = {}
        self.known = np.zeros((1024, self.table.shape[1]), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.index.clear()
        index = self.index
        new = list(dict.fromkeys(w for w in words if w not in index))
        if new:
            ids = np.array([features(w) for w in new])
            fresh = self.embedding[ids].mean(axis=1) @ self.table
            while len(index) + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[len(index) : len(index) + len(new)] = fresh
            for w in new:
                index[w] = len(index)
        return self.known[np.fromiter(map(index.__getitem__, words), np.intp, len(words))]


def _log_odds(docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray) -> np.ndarray:
    seen = np.zeros((2, BUCKETS))
    for doc, label in zip(docs, y, strict=True):
        seen[label, np.unique(feats[np.unique(doc)])] += 1
    n = np.bincount(y, minlength=2)
    return np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))


def train(texts: list[str | None], labels: list[int], langs: list[str | None], prior: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train on rows at hand. ``prior``: the share of label 1 in all rows."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, int)
    step = max(1, -(-len(texts) // LANGUAGE_SAMPLE))
    language = langid.fit_texts(texts[::step], [x or langid.UNKNOWN for x in langs[::step]])
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, :4] += 1.0 / len(w)
    model = Model(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.5, {}, 0.0, language, False)
    if len(np.unique(y)) < 2:
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _words((t or "").lower())], np.int64) for t in texts]
    feats = np.array([features(w) for w in vocabulary] or np.zeros((0, FEATURES)), np.int64).reshape(-1, FEATURES)
    held = rng.random(len(y)) < 0.2
    model.embedding[:, 0] = np.clip(_log_odds([d for d, h in zip(docs, held, strict=True) if not h], feats, y[~held]), -3, 3)
    share = y.mean()
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    weight = weight / weight.mean()
    squares: dict[str, np.ndarray] = {"e": np.full(BUCKETS, 1e-2), "o": np.full(len(model.out), 1e-2), "b": np.full(len(model.bias), 1e-2)}
    for k, w in enumerate(filters):
        squares[f"f{k}"] = np.full(w.shape, 1e-2)
    order = np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            _step(model, [docs[i] for i in order[at : at + BATCH]], feats, y[order[at : at + BATCH]], weight[order[at : at + BATCH]], squares)
    model.trained = True
    cache = _Responses(model)
    z = model.logits(texts, cache)
    spoken = np.array([x[0] for x in language.predict(texts)])
    model.threshold = _cut(z[held], y[held], weight[held])
    for name in sorted(set(spoken)):
        own = held & (spoken == name)
        if (y[own] == 1).sum() >= 10 and (y[own] == 0).sum() >= 10:
            model.thresholds[str(name)] = _cut(z[own], y[own], weight[own])
    return model


def _cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the longest range of thresholds with the fewest errors."""
    if len(np.unique(y)) < 2:
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    errors = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))]) + np.concatenate([np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    gaps = edges[best + 1] - edges[best]
    k = best[gaps.argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def _step(model: Model, docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray, weight: np.ndarray, squares: dict[str, np.ndarray], rate: float = 0.05) -> None:
    """One AdaGrad step; gradients pass through the pooled positions only."""
    lengths = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    tokens = np.full(int((lengths + 2).sum()) + 2, -1)
    for s, d in zip(starts, docs, strict=True):
        tokens[s : s + len(d)] = d
    real = tokens >= 0
    ids = np.zeros((len(tokens), FEATURES), np.int64)
    ids[real] = feats[tokens[real]]
    emb = model.embedding[ids].mean(axis=1) * real[:, None]
    n = len(tokens) - 2
    pooled, where = [], []
    for k, width in enumerate(WIDTHS):
        conv = sum(emb[j : n + j] @ model.filters[k][j] for j in range(width))
        at = np.stack([s + conv[s : s + m].argmax(axis=0) for s, m in zip(starts, lengths, strict=True)])
        where.append(at)
        pooled.append(np.take_along_axis(conv, at, axis=0))
    raw = np.concatenate(pooled, axis=1) + model.bias
    active = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    d_active = g[:, None] * model.out * (raw > 0)

    def descend(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        squares[name] += grad**2
        value -= (rate * grad / np.sqrt(squares[name])).astype(np.float32)

    rows, grads = [], []
    for k, width in enumerate(WIDTHS):
        d, at = d_active[:, k * FILTERS : (k + 1) * FILTERS], where[k]
        change = np.zeros_like(model.filters[k])
        for j in range(width):
            change[j] = np.einsum("bfd,bf->df", emb[at + j], d)
            rows.append((at + j).ravel())
            grads.append((d[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
        descend(f"f{k}", model.filters[k], change)
    descend("b", model.bias, d_active.sum(axis=0))
    out = model.out.copy()
    descend("o", out, active.T @ g)
    model.out = np.maximum(out, 0.01)
    model.out_bias -= rate * float(g.sum())
    rows_, grads_ = np.concatenate(rows), np.concatenate(grads) / FEATURES
    ok = real[rows_]
    touched, at = np.unique(ids[rows_[ok]].ravel(), return_inverse=True)
    total = np.zeros((len(touched), DIM), np.float32)
    np.add.at(total, at, np.repeat(grads_[ok], FEATURES, axis=0))
    squares["e"][touched] += (total**2).mean(axis=1)
    model.embedding[touched] -= (rate * total / np.sqrt(squares["e"][touched])[:, None]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: tuple[int, int] = SAMPLE) -> Model:
    """Train on about ``sample`` labelled documents of each label.

    ``learn``: a condition on doc_id that training rows meet.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return train([], [], [])
    share = F.when(F.col("toxic") == 1, min(1.0, sample[1] / sizes[1])).otherwise(min(1.0, sample[0] / sizes[0]))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0
    picked = known.where(drawn < share).orderBy(drawn, "doc_id").limit(2 * sum(sample))
    rest = F.length("text") - FIT_CHARS
    window = F.when(rest > 0, F.substring("text", (1 + F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(rest, F.lit(0)) + 1)).cast("int"), F.lit(FIT_CHARS))).otherwise(F.col("text"))
    texts = docs.select("doc_id", window.alias("text"), "lang")
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang", "toxic").orderBy("doc_id", F.xxhash64("text")).limit(2 * sum(sample)).collect()
    rows = list({r["text"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))}.values())
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows], prior=sizes[1] / sum(sizes.values()))


def score(model: Model, text: Column) -> Column:
    """The score column of a text column."""
    small_batches()
    from pyspark import SparkContext

    sent = SparkContext.getOrCreate().broadcast(model)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _Responses(sent.value)
        for batch in batches:
            texts = batch.to_pylist()
            parts = [sent.value.scores(texts[i : i + 64], cache) for i in range(0, len(texts), 64)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return toxic(text)


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold; learns from all labels."""
    name = free_name(docs, "toxicity")
    found = docs.withColumn(name, score(fit(docs, labels), col("text")))
    return found.where(F.col(name) < 0.5).select(*[col(c) for c in docs.columns])


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 query: learn off the fold whose remainder is 0, score all."""
    model = fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = docs.select("doc_id", score(model, col("text")).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
